"""Commit log and incremental runs: resume, copies, files taken, stored states, sketches."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import gold
from pulsegrid.plans import etl
from pulsegrid.plans import queries as Q
from pulsegrid.schemas import ROLLUPS
from pulsegrid.sinks.runlog import RunLog
from pulsegrid.sources import testdata

TABLES = list(etl.TABLE_PATHS)


@pytest.fixture(scope="module")
def inputs(spark, sf_small):
    """Stored messages and observations, so that every run reads plain Parquet."""
    from pulsegrid.session import scratch_path
    out = []
    for df in (testdata.load_messages(spark, sf_small), Q.observations(spark, sf_small)):
        path = scratch_path(spark, "t_runs")
        df.where("event_id < 400").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def contents(spark, out):
    """Every table, values rounded, as comparable rows."""
    found = {}
    for t in TABLES:
        df = spark.read.parquet(f"{out}/{etl.TABLE_PATHS[t]}")
        df = df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c).cast("string") for c, k in sorted(df.dtypes)])
        found[t] = sorted(map(repr, map(tuple, df.collect())))
    return found


@pytest.fixture(scope="module")
def whole(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    etl.run_etl(spark, out, messages=inputs[0], observations=inputs[1])
    return contents(spark, out)


def half(inputs, k):
    return dict(zip(("messages", "observations"), [df.where(F.col("event_id") % 2 == k) for df in inputs]))


@pytest.mark.parametrize("stop", ["stage", "publish", "gold"])
def test_a_stopped_run_is_finished(spark, inputs, whole, tmp_path, stop):
    out = str(tmp_path)
    etl.run_etl(spark, out, incremental=True, **half(inputs, 0))
    etl.run_etl(spark, out, incremental=True, until=stop, **half(inputs, 1))
    assert etl.resume(spark, out).rows["device_readings"] == 200
    assert etl.resume(spark, out) is None
    assert contents(spark, out) == whole
    etl.run_etl(spark, out, incremental=True, **half(inputs, 1))
    assert contents(spark, out) == whole


def test_a_run_that_died_inside_a_step(spark, inputs, whole, tmp_path, monkeypatch):
    out = str(tmp_path)
    etl.run_etl(spark, out, incremental=True, **half(inputs, 0))
    real = etl.write_table
    calls = []

    def failing(df, path, **kw):
        calls.append(path)
        if path.endswith("device_analytics") and "analytics/" in path:
            raise OSError("disk gone")
        return real(df, path, **kw)
    monkeypatch.setattr(etl, "write_table", failing)
    with pytest.raises(OSError):
        etl.run_etl(spark, out, incremental=True, **half(inputs, 1))
    monkeypatch.undo()
    etl.run_etl(spark, out, incremental=True, **half(inputs, 1))
    assert contents(spark, out) == whole


def test_an_unstaged_run_is_dropped_with_its_files(spark, sf_small, tmp_path):
    msgs = testdata.load_messages(spark, sf_small).where("event_id < 100")
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    testdata.write_message_files(msgs, landing, corrupt_every=0)
    log = RunLog(spark, out)
    number = log.begin("incremental")
    assert log.take(number, "raw", landing)
    res = etl.run_etl(spark, out, raw_path=landing, incremental=True, tables=("device_readings",))
    assert res.rows["device_readings"] == 100
    assert [r.state for r in log.runs()] == ["dropped", "commit"]


def test_files_are_taken_once_and_rewritten_ones_again(spark, tmp_path):
    line = '{"deviceId": "d%d", "timestamp": "2024-01-0%dT00:00:00Z", "readings": {"heartRate": 70}, "messageId": "%s"}\n'
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def run():
        return etl.run_etl(spark, out, raw_path=str(tmp_path / "in"), incremental=True).rows.get("device_readings", 0)
    (tmp_path / "in" / "a.json").write_text(line % (1, 1, "a"))
    assert run() == 1
    assert run() == 0
    (tmp_path / "in" / "b.json").write_text(line % (2, 2, "b") + "not json\n")
    assert run() == 1
    (tmp_path / "in" / "a.json").write_text(line % (1, 1, "a") + line % (3, 3, "c"))
    assert run() == 1  # read again as a whole; the message stored before is known
    log = RunLog(spark, out)
    taken = spark.read.parquet(f"{log.root}/taken/raw")
    assert {r.run: r.n for r in taken.groupBy("run").agg(F.count("*").alias("n")).collect()} == {1: 1, 3: 1, 4: 1}
    bad = spark.read.parquet(f"{out}/quarantine/device_readings")
    assert [r.raw for r in bad.collect()] == ["not json"]
    assert spark.read.parquet(f"{out}/analytics/device_analytics").count() == 3


def test_copies_count_once_inside_and_across_increments(spark, inputs, tmp_path):
    msgs = inputs[0].where("event_id < 50")
    twice = msgs.unionByName(msgs)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    etl.run_etl(spark, a, messages=twice, incremental=True)
    for _ in range(2):
        etl.run_etl(spark, b, messages=msgs, incremental=True)
    for out in (a, b):
        assert spark.read.parquet(f"{out}/processed/device_readings").count() == 50
        d = spark.read.parquet(f"{out}/analytics/device_analytics")
        assert d.agg(F.sum("total_readings")).first()[0] == 50


def test_documents_without_an_id_are_no_copies(spark, inputs, tmp_path):
    obs = inputs[1].where("event_id < 20").withColumn("id", F.lit(None).cast("string"))
    etl.run_etl(spark, str(tmp_path), observations=obs, incremental=True)
    assert spark.read.parquet(f"{tmp_path}/processed/fhir_observations").count() == 20


def test_states_are_merged_and_gold_reads_no_earlier_silver(spark, inputs, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(etl, "MAX_STATES", 2)
    out = str(tmp_path)
    seen = []
    real = gold.from_states
    monkeypatch.setattr(gold, "from_states", lambda state, t, *a: seen.append(
        state._jdf.queryExecution().analyzed().toString() + str(state.inputFiles())) or real(state, t, *a))
    for k in range(4):
        part = [df.where(F.col("event_id") % 4 == k) for df in inputs]
        etl.run_etl(spark, out, messages=part[0], observations=part[1], incremental=True)
    assert contents(spark, out) == whole
    log = RunLog(spark, out)
    assert all(len(names) <= 2 for names in log.last_commit()["states"].values())
    assert seen and not any("processed/" in plan for plan in seen)


def test_tables_from_before_the_log(spark, inputs, whole, tmp_path):
    """Silver that no run recorded: its states are taken from it once."""
    out = str(tmp_path)
    first = half(inputs, 0)
    etl.silver_readings(first["messages"]).write.partitionBy("date", "device_type").parquet(
        f"{out}/processed/device_readings")
    from pulsegrid.operators import observations as O
    O.observations_wide(first["observations"]).write.parquet(f"{out}/processed/fhir_observations")
    etl.run_etl(spark, out, incremental=True, **half(inputs, 1))
    assert contents(spark, out) == whole


def test_a_gold_table_that_a_run_left_out(spark, inputs, whole, tmp_path):
    out = str(tmp_path)
    etl.run_etl(spark, out, incremental=True, **half(inputs, 0))
    parts = [{k: df.where(F.col("event_id") % 4 == r) for k, df in half(inputs, 1).items()} for r in (1, 3)]
    etl.run_etl(spark, out, incremental=True, tables=("device_readings", "fhir_observations"), **parts[0])
    etl.run_etl(spark, out, incremental=True, **parts[1])
    assert contents(spark, out) == whole


def test_full_run_after_increments_starts_afresh(spark, inputs, whole, tmp_path):
    out = str(tmp_path)
    etl.run_etl(spark, out, incremental=True, **half(inputs, 0))
    etl.run_etl(spark, out, messages=half(inputs, 0)["messages"], observations=half(inputs, 0)["observations"])
    etl.run_etl(spark, out, incremental=True, **half(inputs, 1))
    assert contents(spark, out) == whole


def test_two_jobs_on_one_run_number(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    log.mark("00000001", "begin", kind="incremental")
    with pytest.raises(RuntimeError, match="another job"):
        log.mark("00000001", "begin", kind="incremental")


def test_a_broken_full_run_is_not_built_on(spark, inputs, tmp_path):
    RunLog(spark, str(tmp_path)).begin("full")
    with pytest.raises(RuntimeError, match="full run"):
        etl.run_etl(spark, str(tmp_path), messages=inputs[0], incremental=True)


def test_sketches_merge_to_the_same_estimate(spark):
    rows = spark.range(20000).select(F.lit("k").alias("device_id"), F.lit("t").alias("device_type"),
                                     F.col("id").cast("string").alias("patient_id"), F.lit(1.0).alias("heart_rate"),
                                     F.lit(0).alias("alert_count"), F.lit(False).alias("has_critical_alert"),
                                     F.lit(None).cast("timestamp").alias("ts"))
    r = ROLLUPS["device_analytics"]
    parts = [gold.partial_state(rows.where(F.col("patient_id").cast("int") % 3 == k), r, sketch=True) for k in range(3)]
    many = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert many.count() == 3  # one row a key and part, whatever the number of patients
    one = gold.from_states(gold.partial_state(rows, r, sketch=True), "device_analytics").first()
    merged = gold.from_states(many, "device_analytics").first()
    combined = gold.from_states(gold.combine_state(many, r), "device_analytics").first()
    assert abs(one.unique_patients - 20000) <= 4 * gold.sketch_error() * 20000
    assert abs(merged.unique_patients - 20000) <= 4 * gold.sketch_error() * 20000
    assert combined.unique_patients == merged.unique_patients
    assert (merged.total_readings, merged.avg_heart_rate_reading) == (20000, 1.0)
