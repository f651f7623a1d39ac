"""The registry query trains whole runs with the job's own number of trees."""

from pyspark.sql import functions as F

from pulsegrid.operators import ml
from pulsegrid.plans import queries
from pulsegrid.sources import testdata


def test_model_latest_runs_are_whole(spark, sf_small, monkeypatch):
    runs = []

    def run(spark, messages, root, model_type="anomaly_detection", trees=ml.TRAIN_N_ESTIMATORS, at=None):
        runs.append((trees, at, messages.count(), model_type))
        one = spark.createDataFrame([(model_type, "id", "path", at, 1)],
                                    "model_type string, model_id string, model_path string, "
                                    "updated_at timestamp, training_samples long")
        one.write.mode("append").parquet(f"{root}/registry")

    monkeypatch.setattr(ml, "train_and_register", run)
    monkeypatch.setattr(queries, "_KEPT", {})
    assert queries.q_model_latest(spark, sf_small).count() == 2
    ts = F.try_to_timestamp("timestamp")
    messages = testdata.load_messages(spark, sf_small)
    early, whole = messages.where(ts <= F.lit(runs[0][1])).count(), messages.count()
    assert [(kind, n) for _, _, n, kind in runs] == [
        ("anomaly_detection", early), ("anomaly_detection", whole), ("critical_detection", whole)]
    assert {trees for trees, _, _, _ in runs} == {ml.TRAIN_N_ESTIMATORS}
