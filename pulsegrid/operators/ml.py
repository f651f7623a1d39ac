"""Model (re)training and scoring as Spark ML jobs.

Label: a statement about the device's *next* reading (``TARGETS``, one per model
type; by default that it is abnormal, threshold scorer level not NORMAL). Features:
the seven vitals (absent = -1), alert count and hour of the current reading.
Gradient-boosted trees with the fixed hyper-parameters (depth 5, 100 trees, rate
0.1); a deterministic hash split of message ids holds out ~20% for validation.
Metrics: accuracy, precision, recall and F1 of the positive class, ROC AUC.

``score_latest`` scores messages with the model that the registry's latest pointer
names for each type and stamps every row with its ``model_id``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.vocab import (TRAIN_LEARNING_RATE, TRAIN_MAX_DEPTH, TRAIN_N_ESTIMATORS,
                               VITAL_COLUMNS)
from .enrich import flatten_messages
from .sequence import with_next

FEATURES = [*VITAL_COLUMNS, "alert_count", "hour"]
# what a model type predicts of the next reading, from its alert level
TARGETS = {
    "anomaly_detection": lambda level: level != F.lit("NORMAL"),
    "critical_detection": lambda level: level == F.lit("CRITICAL"),
}


def _features() -> list:
    return [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in FEATURES]


def _target(model_type: str):
    if model_type not in TARGETS:
        raise ValueError(f"unknown model type: {model_type}")
    return TARGETS[model_type]


def scored_readings(messages: DataFrame) -> DataFrame:
    """Device messages -> time, features and own alert level of each, one row per message."""
    scored = flatten_messages(messages.withColumn(
        "alert_level", S.level_of(S.reading_tenths(F.col("readings")))))
    return scored.select("message_id", "device_id", "ts", "alert_level", *_features())


def next_targets(scored: DataFrame, bucket: str = "1 hour", model_type: str = "anomaly_detection") -> DataFrame:
    """Scored readings -> features of each + label of the device's next one."""
    own = scored.where(F.col("ts").isNotNull()).withColumn("abnormal", _target(model_type)(F.col("alert_level")))
    nxt = with_next(own, "device_id", ["ts", "message_id"], ["abnormal"], F.date_trunc(_unit(bucket), F.col("ts")))
    return (nxt.where(F.col("next").isNotNull())
            .select("message_id", "device_id", *FEATURES, F.col("next.abnormal").cast("double").alias("label")))


def training_set(messages: DataFrame, bucket: str = "1 hour", model_type: str = "anomaly_detection") -> DataFrame:
    """Device messages -> features of each reading + label of the device's next one."""
    return next_targets(scored_readings(messages), bucket, model_type)


def _unit(bucket: str) -> str:
    return {"1 day": "day", "1 hour": "hour", "1 week": "week", "1 month": "month"}[bucket]


def split(ds: DataFrame, holdout_mod: int = 5):
    """Deterministic ~1/holdout_mod validation split: the first eight hex digits
    of the message id's MD5, modulo."""
    bucket = F.conv(F.substring(F.md5(F.col("message_id")), 1, 8), 16, 10).cast("bigint")
    v = F.pmod(bucket, F.lit(holdout_mod)) == 0
    return ds.where(~v), ds.where(v)


@dataclass
class TrainResult:
    model: object
    metrics: dict
    training_samples: int
    validation_samples: int


def train(train_df: DataFrame, valid_df: DataFrame, predictions_path: str,
          trees: int = TRAIN_N_ESTIMATORS) -> TrainResult:
    """Fit and evaluate; the validation predictions are written once, their counts by
    label and prediction give all metrics but the area under the curve."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    from .boosting import HistogramBoosting

    rows = train_df.count()
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        HistogramBoosting(labelCol="label", featuresCol="features", maxDepth=TRAIN_MAX_DEPTH,
                          maxIter=trees, stepSize=TRAIN_LEARNING_RATE),
    ])
    model = pipe.fit(train_df)
    (model.transform(valid_df).select("message_id", "label", "prediction", "rawPrediction")
     .write.mode("overwrite").parquet(predictions_path))
    pred = train_df.sparkSession.read.parquet(predictions_path)
    n = {(r.label, r.prediction): r["count"] for r in pred.groupBy("label", "prediction").count().collect()}
    hits, total = n.get((1.0, 1.0), 0), sum(n.values())
    said, are = hits + n.get((0.0, 1.0), 0), hits + n.get((1.0, 0.0), 0)
    share = lambda a, b: a / b if b else 0.0
    metrics = {
        "accuracy": share(hits + n.get((0.0, 0.0), 0), total),
        "precision": share(hits, said), "recall": share(hits, are), "f1_score": share(2 * hits, said + are),
        "auc_roc": BinaryClassificationEvaluator(
            labelCol="label", rawPredictionCol="rawPrediction",
            metricName="areaUnderROC").evaluate(pred),
    }
    return TrainResult(model, metrics, rows, total)


def train_and_register(spark: SparkSession, messages: DataFrame, root: str,
                       model_type: str = "anomaly_detection", trees: int = TRAIN_N_ESTIMATORS,
                       at: datetime | None = None) -> DataFrame:
    """Train, save the model and its info file, append a registry record; return
    the registry. ``messages``: device messages, or stored ``scored_readings`` of them,
    which several runs can read. ``at``: time of the run (now), the same in all of them."""
    from ..sinks import registry as R

    _target(model_type)  # an unknown type ends here, before anything is written
    at = at or datetime.now(timezone.utc)
    folder = f"{root.rstrip('/')}/models/{model_type}/{at:%Y%m%d-%H%M%S}"
    # Materialise the scored readings and the labelled set once (durable tables, not a
    # cache): the windows read the readings on two branches, the booster the set many times.
    if "alert_level" not in messages.columns:
        scored_readings(messages).write.mode("overwrite").parquet(f"{folder}/readings")
        messages = spark.read.parquet(f"{folder}/readings")
    next_targets(messages, model_type=model_type).write.mode("overwrite").parquet(f"{folder}/training_set")
    tr, va = split(spark.read.parquet(f"{folder}/training_set"))
    res = train(tr, va, f"{folder}/predictions", trees=trees)
    res.model.write().overwrite().save(f"{folder}/model")
    record = R.record(spark, root, model_type, at, res.metrics, {
        "max_depth": TRAIN_MAX_DEPTH, "n_estimators": trees, "learning_rate": TRAIN_LEARNING_RATE},
        res.training_samples, res.validation_samples)
    R.write_info(record)
    R.append_records(record, f"{root}/registry")
    return spark.read.parquet(f"{root}/registry")


def score_latest(registry: DataFrame, messages: DataFrame) -> DataFrame:
    """message_id, device_id, model_type, model_id, probability, positive: every message
    scored by the latest model of each type in the registry."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from ..sinks import registry as R
    rows = flatten_messages(messages).select("message_id", "device_id", *_features())
    out = None
    for r in R.latest(registry).orderBy("model_type").collect():  # one row per model type
        model = PipelineModel.load(r["model_path"].rsplit("/", 1)[0] + "/model")
        scored = model.transform(rows).select(
            "message_id", "device_id", F.lit(r["model_type"]).alias("model_type"),
            F.lit(r["model_id"]).alias("model_id"),
            vector_to_array("probability")[1].alias("probability"), (F.col("prediction") == 1.0).alias("positive"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("the registry holds no model")
    return out
