"""Model registry: append-only records + a 'latest' view per model type."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("training_timestamp", T.TimestampType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("training_samples", T.LongType()),
    T.StructField("validation_samples", T.LongType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])


def model_id(model_type: F.Column, ts: F.Column) -> F.Column:
    return F.concat(model_type, F.lit("-"), F.date_format(ts, "yyyyMMdd-HHmmss"))


def model_path(root: str, model_type: F.Column, ts: F.Column) -> F.Column:
    return F.concat(F.lit(root.rstrip("/") + "/models/"), model_type, F.lit("/"),
                    F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("/model_info.json"))


def record(spark: SparkSession, root: str, model_type: str, at: datetime, metrics: dict,
           hyperparameters: dict, training_samples: int, validation_samples: int) -> DataFrame:
    """One registry record; ``model_path`` names the run's info file, beside its model."""
    kind, ts = F.lit(model_type), F.lit(at)
    numbers = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])
    return spark.range(1).select(
        kind.alias("model_type"), model_id(kind, ts).alias("model_id"), ts.alias("training_timestamp"),
        numbers(metrics).alias("metrics"), numbers(hyperparameters).alias("hyperparameters"),
        F.lit(training_samples).cast("bigint").alias("training_samples"),
        F.lit(validation_samples).cast("bigint").alias("validation_samples"),
        model_path(root, kind, ts).alias("model_path"), ts.alias("updated_at"))


def write_info(one: DataFrame) -> str:
    """The record as a JSON document at its ``model_path``."""
    spark = one.sparkSession
    row = one.select("model_path", F.to_json(F.struct(*one.columns)).alias("body")).first()
    path = spark._jvm.org.apache.hadoop.fs.Path(row["model_path"])
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(path, True)
    try:
        out.write(bytearray(row["body"].encode()))
    finally:
        out.close()
    return row["model_path"]


def append_records(records: DataFrame, registry_path: str) -> None:
    cols = [f.name for f in REGISTRY.fields]
    records.select(*cols).write.mode("append").parquet(registry_path)


def latest(registry: DataFrame) -> DataFrame:
    """Latest record per model type (the 'latest' pointer)."""
    rec = F.struct("model_id", "model_path", "updated_at", "training_samples")
    return (registry.groupBy("model_type")
            .agg(F.max_by(rec, F.struct("updated_at", "model_id")).alias("r"))
            .select("model_type", "r.*"))
