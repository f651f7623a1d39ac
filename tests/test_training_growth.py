"""Training: one evaluation of the messages, even tasks in whole waves, one sibling added up of two."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.functions import scoring as S
from pulsegrid.operators import boosting, ml
from pulsegrid.plans import queries
from pulsegrid.sources import testdata


def test_messages_are_evaluated_once(spark, sf_small, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    messages = testdata.load_messages(spark, sf_small)
    stage = SimpleNamespace(save=lambda path: None)
    stage.overwrite = lambda: stage
    monkeypatch.setattr(ml, "train", lambda tr, va, path, trees: ml.TrainResult(
        SimpleNamespace(write=lambda: stage), {}, tr.count(), va.count()))
    monkeypatch.setattr("pulsegrid.sinks.registry.record", lambda *a: None)
    monkeypatch.setattr("pulsegrid.sinks.registry.write_info", lambda one: None)
    monkeypatch.setattr("pulsegrid.sinks.registry.append_records", lambda one, path: messages.limit(1)
                        .write.parquet(path))
    ml.train_and_register(spark, messages.mapInArrow(count, messages.schema), str(tmp_path))
    assert seen.value == messages.count()
    stored = spark.read.parquet(f"{tmp_path}/models/*/*/training_set")
    whole = ml.training_set(messages)
    assert stored.count() == whole.count() > 0
    assert stored.exceptAll(whole).count() == 0


def test_runs_share_one_evaluation(spark, sf_small, monkeypatch):
    """The three trainings read stored scores, the same rows as those of the messages."""
    seen, sets = spark.sparkContext.accumulator(0), []

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    messages = testdata.load_messages(spark, sf_small)
    counted = messages.mapInArrow(count, messages.schema)
    monkeypatch.setattr(queries, "_KEPT", {})
    monkeypatch.setattr(testdata, "load_messages", lambda *a: counted)
    monkeypatch.setattr(ml, "train_and_register", lambda spark, msgs, root, model_type="anomaly_detection", at=None:
                        sets.append((ml.next_targets(msgs, model_type=model_type).collect(), model_type, at)))
    queries._model_root(spark, sf_small)
    assert seen.value == messages.count()
    for rows, kind, at in sets:
        until = messages.where(F.try_to_timestamp("timestamp") <= F.lit(at))
        assert sorted(rows) == sorted(ml.training_set(until, model_type=kind).collect())


def test_lean_score_equals_that_of_the_anomalies(spark):
    keys = [*S.KEY_TO_METRIC, *S.KEY_TO_METRIC.values(), "unknown"]
    maps = [None, {}, {"heartRate": None}, {"heartRate": 200.0, "heart_rate": 30.0, "temperature": float("nan")},
            *[{k: v} for k in keys for v in (-1.0, 8.0, 35.0, 40.0, 49.0, 61.0, 89.0, 91.0, 121.0, 150.5, 181.0,
                                             float("nan"), None)],
            *[{k: v for k in keys} for v in (0.0, 37.0, 100.0, 1000.0)]]
    rows = spark.createDataFrame([(m,) for m in maps], "readings map<string,double>")
    r = F.col("readings")
    # a map of JSON may name a key twice: both readings count
    rows = rows.unionAll(spark.createDataFrame([('{"heartRate": 200, "heartRate": 45}',)], "j string").select(
        F.from_json("j", "map<string,double>").alias("readings")))
    got = rows.select(S.reading_tenths(r).alias("lean"), S.risk_tenths(S.threshold_anomalies(r)).alias("full")).collect()
    assert len(got) == len(maps) + 1
    assert [x.lean for x in got] == [x.full for x in got]
    assert len({x.lean for x in got}) >= 4


def test_tasks_fill_whole_waves():
    assert boosting._tasks(80_000, 8) == 1
    assert boosting._tasks(500_000, 8) == 4
    assert boosting._tasks(4_657_325, 8) == 8  # ten tasks were two waves on eight cores
    assert boosting._tasks(28_000_000, 12) == 24


def test_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 100)
    df = spark.range(0, 40_000, 1, 8).where("id >= 35000 or id < 1000").select(
        F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("label"))
    monkeypatch.setattr(boosting, "_numbers", lambda d, c: d.withColumn("_x", F.col(c)))
    state = boosting.HistogramBoosting._blocks(df, "x", "label", 1, [[500.0]], 4)
    rows = state.mapPartitions(lambda it: [sum(len(b[1]) for b in it)]).collect()
    assert sum(rows) == 6000 and len(rows) == 4
    assert max(rows) - min(rows) <= 200


def test_siblings_are_what_the_parent_leaves():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 32, (3, 6000)).astype(np.uint16)
    codes = np.stack([bins[0] | bins[1] << 5, bins[2]]).astype(np.uint16)
    g = (np.rint(rng.uniform(-4, 4, 6000) * 2 ** 18) / 2 ** 18).astype(np.float32)
    blocks = [(codes[:, a:a + 2000], None, None, g[a:a + 2000]) for a in (0, 2000, 4000)]
    # the first node of the second level sends all its rows left
    splits = [(np.array([1]), np.array([3])), (np.array([0, 2]), np.array([31, 25]))]
    whole = [next(boosting._histogram(splits[:k], k, 3)(iter(blocks))) for k in range(3)]
    for k in (0, 1):
        fewer = boosting._fewer(whole[k][0], *splits[k])
        part = next(boosting._histogram(splits[:k + 1], k + 1, 3, fewer)(iter(blocks)))
        assert part.shape[1] == 2 ** k
        assert np.array_equal(boosting._with_siblings(whole[k], part, fewer), whole[k + 1])
        rows = whole[k + 1][0, :, 0].sum(1)
        assert all(rows[i] <= rows[i ^ 1] for i in fewer)
