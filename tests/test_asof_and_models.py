"""History as of a time, and scoring with the latest model."""

import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ml, predict
from pulsegrid.sinks import registry as R
from pulsegrid.sources import testdata

DAY = datetime(2024, 1, 10, tzinfo=timezone.utc)


def rows(spark):
    data = [("p1", DAY + timedelta(days=d, hours=h), 60.0 + 3 * d + h, 100.0 + d * d)
            for d in range(-12, 3) for h in (1, 20)]
    data += [("p2", DAY, 70.0, None), ("p1", None, 500.0, 500.0), (None, DAY, 1.0, 1.0)]
    return spark.createDataFrame(data, "patient_id string, ts timestamp, heart_rate double, systolic_bp double"), data


def test_only_whole_days_before_the_request(spark):
    df, data = rows(spark)
    asked = [("p1", DAY + timedelta(hours=13)), ("p1", DAY + timedelta(hours=2)), ("p1", DAY + timedelta(days=30)),
             ("p1", DAY - timedelta(days=11)), ("p2", DAY + timedelta(days=1)), ("p3", DAY)]
    req = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, patient_id string, requested_at timestamp")
    got = {(r.patient_id, r.asked.isoformat()): r for r in predict.history_asof(req, predict.daily_states(df), 7).collect()}
    assert len(got) == 3  # no history: no row
    for p, at in asked[:2] + asked[3:5]:
        day = at.replace(hour=0)
        seen = [x for x in data if x[0] == p and x[1] and day - timedelta(days=7) <= x[1] < day]
        r = got[p, day.date().isoformat()]
        assert r.history_readings == len(seen)
        for at_, name in ((2, "lake_heart_rate_variance"), (3, "lake_bp_variance")):
            values = [x[at_] for x in seen if x[at_] is not None]
            want = statistics.variance(values) if len(values) > 1 else None
            assert r[name] == (None if want is None else pytest.approx(want))
    patients = spark.createDataFrame([("p1", 50, 2, 0, 0.5, None, None), ("p2", 50, 2, 0, 0.5, 9.0, 8.0)],
                                     "patient_id string, age int, chronic_conditions int, recent_hospitalizations int, "
                                     "medication_adherence double, heart_rate_variance double, bp_variance double")
    f = {r.n: r for r in predict.features_asof(patients, req, predict.daily_states(df), keep=("n",)).collect()}
    assert len(f) == 6
    assert f[2].history_readings == 0 and (f[2].f_hr_variance, f[2].f_bp_variance) == (10.0, 15.0)
    assert (f[4].history_readings, f[4].f_hr_variance) == (1, 9.0)  # one reading has no variance: the registry's


def test_states_of_days_can_be_stored_side_by_side(spark):
    df, _ = rows(spark)
    early = predict.daily_states(df.where(F.col("ts") < F.lit(DAY)))
    late = predict.daily_states(df.where(F.col("ts") >= F.lit(DAY)))
    key = ["patient_id", "day"]
    both = sorted(map(tuple, early.unionByName(late).orderBy(*key).collect()))
    assert both == sorted(map(tuple, predict.daily_states(df).orderBy(*key).collect()))


def test_scoring_follows_the_latest_pointer(spark, sf_small, tmp_path):
    msgs = testdata.load_messages(spark, sf_small)
    root = str(tmp_path)
    for day, kind in ((1, "anomaly_detection"), (2, "anomaly_detection"), (1, "critical_detection")):
        reg = ml.train_and_register(spark, msgs, root, kind, trees=2, at=datetime(2024, 2, day, tzinfo=timezone.utc))
    s = ml.score_latest(reg, msgs)
    n = {r.model_id: (r["n"], r.positive) for r in s.groupBy("model_id").agg(
        F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("positive")).collect()}
    assert {k: v[0] for k, v in n.items()} == {"anomaly_detection-20240202-000000": msgs.count(),
                                               "critical_detection-20240201-000000": msgs.count()}
    # the same rows as the stored model gives to the stored features
    from pyspark.ml import PipelineModel
    place = f"{root}/models/anomaly_detection/20240202-000000"
    data = PipelineModel.load(f"{place}/model").transform(spark.read.parquet(f"{place}/training_set"))
    both = data.select("message_id", "prediction").join(
        s.where("model_type = 'anomaly_detection'"), "message_id")
    assert both.count() == data.count() and both.where((F.col("prediction") == 1.0) != F.col("positive")).isEmpty()
    with pytest.raises(ValueError, match="no model"):
        ml.score_latest(reg.limit(0), msgs)
    with pytest.raises(ValueError, match="unknown model type"):
        ml.training_set(msgs, model_type="weather")


def test_metrics_equal_the_evaluators(spark, sf_small, tmp_path):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    ds = ml.training_set(testdata.load_messages(spark, sf_small))
    tr, va = ml.split(ds)
    res = ml.train(tr, va, str(tmp_path / "p"), trees=3)
    pred = spark.read.parquet(str(tmp_path / "p"))
    mc = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for name, theirs in (("accuracy", "accuracy"), ("precision", "precisionByLabel"), ("recall", "recallByLabel"),
                         ("f1_score", "fMeasureByLabel")):
        assert res.metrics[name] == pytest.approx(mc.evaluate(pred, {mc.metricName: theirs, mc.metricLabel: 1.0}))


def test_latest_of_a_tie(spark):
    at = datetime(2024, 2, 1, tzinfo=timezone.utc)
    reg = [R.record(spark, "/r", k, at, {"a": 1}, {}, 1, 1) for k in ("x", "x", "y")]
    got = R.latest(reg[0].unionByName(reg[1]).unionByName(reg[2])).collect()
    assert sorted(r.model_id for r in got) == ["x-20240201-000000", "y-20240201-000000"]
