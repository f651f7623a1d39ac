"""Batch ETL, stream = batch, replay idempotence, properties across tables."""

from pyspark.sql import functions as F

from pulsegrid.operators import gold
from pulsegrid.plans import etl
from pulsegrid.plans import queries as Q
from pulsegrid.session import scratch_path
from pulsegrid.sources import testdata
from pulsegrid.streaming import pipeline as P


def test_etl_writes_five_tables(spark, sf_small):
    msgs = testdata.load_messages(spark, sf_small)
    landing = testdata.write_message_files(msgs, scratch_path(spark, "t_landing"))
    res = etl.run_etl(spark, scratch_path(spark, "t_etl"), raw_path=landing,
                      observations=Q.observations(spark, sf_small))
    n_events = testdata.load_table(spark, sf_small, "events").count()
    n_bad = testdata.load_table(spark, sf_small, "events").where("event_id % 97 = 0").count()
    assert res.rows["device_readings"] == n_events - n_bad
    assert res.rows["fhir_observations"] == n_events
    parts = spark.read.parquet(res.path("device_readings")).select("date", "device_type")
    assert parts.distinct().count() > 1
    counts = {r["table_name"]: r["rows"] for r in etl.read_back_counts(spark, res).collect()}
    assert counts == {k: v for k, v in res.rows.items()}


def test_empty_input_skips_writes(spark, sf_small):
    import pytest
    out = scratch_path(spark, "t_empty")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        etl.run_etl(spark, out, raw_path="/nonexistent/pg/raw")
    msgs = testdata.load_messages(spark, sf_small)
    full = etl.run_etl(spark, out, messages=msgs)
    before = {t: spark.read.parquet(full.path(t)).count() for t in full.rows}
    res = etl.run_etl(spark, out, raw_path="/nonexistent/pg/raw", missing_ok=True)
    assert res.rows == {"device_readings": 0}
    assert {t: spark.read.parquet(full.path(t)).count() for t in full.rows} == before


def test_blank_lines_and_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"deviceId": "d1", "timestamp": "2024-01-01T00:00:00Z", "readings": {"heartRate": 70}}\n'
        '\n   \n[]\nnull\n{"deviceId": \n')
    res = etl.run_etl(spark, str(tmp_path / "out"), raw_path=str(tmp_path / "in"))
    assert res.rows["device_readings"] == 1 and res.rejects["device_readings"] == 3
    kept = spark.read.parquet(res.reject_path("device_readings"))
    assert {r.raw for r in kept.collect()} == {"[]", "null", '{"deviceId": '}


def test_documents_are_read_whole(spark, sf_small, tmp_path):
    from pulsegrid.sinks.tables import export_documents
    obs = Q.observations(spark, sf_small)
    export_documents(obs, str(tmp_path / "lines"))
    res = etl.run_etl(spark, str(tmp_path / "a"), fhir_path=str(tmp_path / "lines"))
    assert res.rows["fhir_observations"] == obs.count() and res.rejects["fhir_observations"] == 0
    # read as one document per file, files with several are rejects, not shorter
    res = etl.run_etl(spark, str(tmp_path / "b"), fhir_path=str(tmp_path / "lines"), multiline=True)
    files_in = len(list((tmp_path / "lines").rglob("*.txt")))
    assert res.rows["fhir_observations"] + res.rejects["fhir_observations"] == files_in
    text = "".join(r.raw for r in spark.read.parquet(res.reject_path("fhir_observations")).collect())
    assert text.count('"resourceType"') + res.rows["fhir_observations"] == obs.count()


def test_published_messages_keep_their_rows(spark, tmp_path):
    """No topic and no message id in the body; alerts sent along are not trusted."""
    import json
    body = {"deviceId": "w1", "deviceType": "smartwatch", "timestamp": "2024-01-01T00:00:00Z",
            "readings": {"heartRate": 180, "bloodOxygen": 70}, "alerts": []}
    for folder, extra in (("wearables/w1", {}), ("wearables/w1", {"readings": {"heartRate": 60}}),
                          ("elsewhere/w1", {"deviceId": "w2"})):
        d = tmp_path / "in" / folder
        d.mkdir(parents=True, exist_ok=True)
        with open(d / "m.json", "a") as f:
            f.write(json.dumps({**body, **extra}) + "\n")
    paths = P.run_ingest(spark, str(tmp_path / "in"), P.StreamPaths(str(tmp_path / "in"), str(tmp_path / "out")))
    rows = spark.read.parquet(paths.sink("enriched")).collect()
    assert {(r.topic, r.alertSeverity) for r in rows} == {("iomt/wearables/w1", "critical"),
                                                          ("iomt/wearables/w1", "normal")}
    assert all(len(r.processingRequestId) == 36 for r in rows)
    bad = spark.read.parquet(paths.sink("quarantine")).collect()
    assert [r.reason for r in bad] == ["unsubscribed"]
    P.run_to_completion(P.start_observations(P.enriched_source(spark, paths), paths))
    assert spark.read.parquet(paths.sink("observations")).select("id").distinct().count() == 2


def test_next_row_of_null_keys_and_times(spark):
    from pulsegrid.operators.sequence import with_next
    df = spark.createDataFrame([(1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 03:00:00"),
                                (3, "a", None), (4, "a", "2024-01-01 00:00:00")], "id int, k string, t string")
    df = df.withColumn("t", F.to_timestamp("t"))
    got = with_next(df, "k", ["t", "id"], ["id"], F.date_trunc("hour", "t"))
    assert {r.id: r.next and r.next.id for r in got.collect()} == {1: 2, 2: None, 3: 4, 4: None}


def test_model_registry_can_be_followed(spark, sf_small, tmp_path):
    import json

    from pyspark.ml import PipelineModel

    from pulsegrid.operators import ml
    reg = ml.train_and_register(spark, testdata.load_messages(spark, sf_small), str(tmp_path), trees=2)
    path = reg.first()["model_path"]
    info = json.loads(open(path).read())
    assert info["model_id"] == reg.first()["model_id"] and set(info["metrics"]) == {
        "accuracy", "precision", "recall", "f1_score", "auc_roc"}
    assert len(PipelineModel.load(path.rsplit("/", 1)[0] + "/model").stages) == 2


def test_basic_documents_below_processing_date(spark, sf_small, tmp_path):
    from pulsegrid.sinks.tables import export_by_processing_date
    obs = Q.observations(spark, sf_small, basic=True).limit(20)
    export_by_processing_date(obs, str(tmp_path / "p"))
    back = spark.read.text(str(tmp_path / "p"))
    assert back.count() == 20 and {"year", "month", "day"} <= set(back.columns)


def test_local_folder_only_on_a_local_master(monkeypatch, spark):
    import pytest

    from pulsegrid import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_hourly_sums_equal_device_totals(spark, sf_small):
    r = Q.readings(spark, sf_small)
    h = gold.hourly_trends(r).agg(F.sum("reading_count"), F.sum("total_alerts")).first()
    d = gold.device_analytics(r).agg(F.sum("total_readings"), F.sum("total_alerts")).first()
    assert tuple(h) == tuple(d)


def test_score_range_and_severity_property(spark, sf_small):
    r = Q.readings(spark, sf_small)
    d = gold.device_analytics(r)
    assert d.where((F.col("device_health_score") < 0)
                   | (F.col("device_health_score") > 100)).count() == 0
    assert r.where((F.col("alert_severity") == "critical")
                   & (F.col("alert_count") == 0)).count() == 0


def test_stream_equals_batch_and_replay_adds_nothing(spark, sf_small):
    msgs = testdata.load_messages(spark, sf_small)
    landing = testdata.write_message_files(msgs, scratch_path(spark, "t_stream"), files=3)
    paths = P.run_ingest(spark, landing)
    streamed = spark.read.parquet(paths.sink("enriched"))
    from pulsegrid.sources import files
    batch = P.enriched_stream(files.read_device_messages(spark, landing).withColumn(
        "raw", F.lit(None)))
    cols = ["messageId", "deviceId", "alertSeverity", "timestamp"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0
    n = streamed.count()
    # a second availableNow run over the same files processes nothing new
    P.run_ingest(spark, landing, paths=paths)
    assert spark.read.parquet(paths.sink("enriched")).count() == n
    # observations: a replayed message keeps its id; the stream drops the copy
    P.run_to_completion(P.start_observations(P.enriched_source(spark, paths), paths))
    o = spark.read.parquet(paths.sink("observations"))
    assert o.count() == n and o.select("id").distinct().count() == n
    q = spark.read.parquet(paths.sink("quarantine"))
    assert q.count() == msgs.where("event_id % 97 = 0").count()


def test_next_reading_matches_plain_lead(spark, sf_small):
    from pyspark.sql import Window

    from pulsegrid.operators.sequence import with_next
    r = Q.readings(spark, sf_small)
    a = with_next(r, "device_id", ["ts", "event_id"], ["event_id"],
                  F.date_trunc("hour", F.col("ts"))).select("event_id", F.col("next.event_id")
                                                             .alias("n"))
    w = Window.partitionBy("device_id").orderBy("ts", "event_id")
    b = r.select("event_id", F.lead("event_id").over(w).alias("n"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_catalog_registration(spark, sf_small):
    from pulsegrid.sources import catalog
    msgs = testdata.load_messages(spark, sf_small)
    landing = testdata.write_message_files(msgs, scratch_path(spark, "t_cat"))
    res = etl.run_etl(spark, scratch_path(spark, "t_cat_etl"), raw_path=landing)
    db = catalog.create_database(spark)
    names = catalog.register_etl_tables(spark, db, res)
    n = spark.sql(f"SELECT count(*) AS n FROM {names['device_readings']}").first()["n"]
    assert n == res.rows["device_readings"]


def test_landing_registered_with_schema(spark, sf_small):
    from pulsegrid.sources import catalog
    msgs = testdata.load_messages(spark, sf_small)
    landing = testdata.write_message_files(msgs, scratch_path(spark, "t_reg_landing"))
    db = catalog.create_database(spark)
    name = catalog.register_landing(spark, db, "raw_messages", landing)
    got = spark.sql(f"SELECT count(*) AS n, count(deviceId) AS d FROM {name}").first()
    assert got["n"] == msgs.count()
    assert got["d"] == msgs.where("event_id % 97 <> 0").count()


def test_incremental_etl_keeps_other_partitions(spark, sf_small):
    """An incremental run keeps all earlier rows, of the same dates too, and a
    repeated one adds nothing."""
    msgs = testdata.load_messages(spark, sf_small)
    out = scratch_path(spark, "t_incr")
    first, second = msgs.where("event_id % 2 = 0"), msgs.where("event_id % 2 = 1")
    etl.run_etl(spark, out, messages=first)
    for _ in range(2):
        etl.run_etl(spark, out, messages=second, incremental=True)
    back = spark.read.parquet(f"{out}/{etl.TABLE_PATHS['device_readings']}")
    assert back.count() == msgs.count()
    # a full refresh replaces everything
    etl.run_etl(spark, out, messages=second)
    assert spark.read.parquet(f"{out}/{etl.TABLE_PATHS['device_readings']}").count() \
        == second.count()


def test_stream_dedupes_producer_resend_and_picks_up_new_files(spark, sf_small):
    """A message landed twice yields one Observation; a later run processes
    only files added since the last one; batches can be bounded by files."""
    msgs = testdata.load_messages(spark, sf_small).where("event_id % 97 <> 0")
    root = scratch_path(spark, "t_resend")
    first = msgs.where("event_id < 500")
    testdata.write_message_files(first, f"{root}/landing/a", corrupt_every=0)
    testdata.write_message_files(first.where("event_id < 100"), f"{root}/landing/b",
                                 corrupt_every=0)   # producer re-sent these
    paths = P.StreamPaths(f"{root}/landing/*", f"{root}/out")
    raw = P.raw_stream(spark, paths.landing, max_files_per_trigger=1)
    q = P.start_enriched(raw, paths)
    P.run_to_completion(q)
    assert len(q.recentProgress) >= 2  # one file per micro-batch
    enriched = spark.read.parquet(paths.sink("enriched"))
    assert enriched.count() == first.count() + first.where("event_id < 100").count()
    P.run_to_completion(P.start_observations(P.enriched_source(spark, paths), paths))
    obs = spark.read.parquet(paths.sink("observations"))
    assert obs.count() == first.count()
    # new files arrive: the next availableNow run only reads those
    later = msgs.where("event_id >= 500")
    testdata.write_message_files(later, f"{root}/landing/c", corrupt_every=0)
    P.run_to_completion(P.start_enriched(P.raw_stream(spark, paths.landing), paths))
    assert spark.read.parquet(paths.sink("enriched")).count() == enriched.count() + later.count()
