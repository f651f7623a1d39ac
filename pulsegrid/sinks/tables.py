"""Parquet table writers.

* ``write_table``: overwrite / append / dynamic partition overwrite, optional
  partition columns; the row count comes from an ``Observation`` metric that
  is collected while the write runs, so the plan is not executed twice.
* ``quarantine``: rows that failed parsing or validation, kept with a reason.
* ``metrics`` / ``model registry`` rows are ordinary appends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame | None, path: str, mode: str = "overwrite",
                partition_cols: list[str] | tuple = (), fmt: str = "parquet",
                dynamic_overwrite: bool = False, skip_if_empty: bool = False,
                max_records_per_file: int | None = None, rebalance: bool = True,
                sort_cols: list[str] | tuple = (), options: dict | None = None) -> int | None:
    """Write ``df`` to ``path``; return the number of rows written.

    ``None`` input (an upstream guard found nothing) skips the write. With
    ``skip_if_empty`` an empty frame also skips it (one cheap limit-1 probe).
    A partitioned write is preceded by a REBALANCE on the partition columns:
    AQE then sizes the write tasks, splitting a hot partition value over
    several tasks and merging small ones, so each value gets a few
    right-sized files instead of one file per input task. ``sort_cols`` order
    the rows inside each file (and partition value).
    """
    if df is None:
        return None
    if skip_if_empty and df.isEmpty():
        return 0
    metric = Observation("write_rows")
    if partition_cols and rebalance:
        df = df.hint("rebalance", *partition_cols)
    if sort_cols:
        df = df.sortWithinPartitions(*partition_cols, *sort_cols)
    observed = df.observe(metric, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode).format(fmt)
    if dynamic_overwrite:
        w = w.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.save(path)
    return int(metric.get.get("rows", 0))


def table_exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def append_table(df: DataFrame, path: str, partition_cols=()) -> int | None:
    return write_table(df, path, mode="append", partition_cols=partition_cols)


def quarantine_rows(df: DataFrame, reason: str, raw_col: str = "_corrupt_record",
                    batch_id: int | None = None) -> DataFrame:
    """Quarantine schema: raw text, reason, batch id."""
    return df.select(F.col(raw_col).alias("raw"), F.lit(reason).alias("reason"),
                     F.lit(batch_id).cast("bigint").alias("batch_id"))


OBSERVATION_PARTITIONS = ["device_type", "observation_date"]
# ids are hexadecimal digits, which only an entropy coder makes shorter
STORE_OPTIONS = {"parquet.bloom.filter.enabled#id": "true", "compression": "zstd"}
EXPORT_ROWS = 250_000  # documents of about 2 KB in one compressed file


def write_observations(obs: DataFrame, path: str, mode: str = "append") -> int | None:
    """Observation store: partitioned by device type and event date (plus the
    metadata columns), the layout search prunes on; inside, files are sorted by
    id and carry a Bloom filter on it, so a read by id skips row groups."""
    return write_table(obs, path, mode=mode, partition_cols=OBSERVATION_PARTITIONS, sort_cols=["id"],
                       options=STORE_OPTIONS)


def write_messages_as_observations(enriched: DataFrame, path: str, mode: str = "append",
                                   keep: tuple = ()) -> int | None:
    """The same store from enriched messages: they are dealt and sorted as messages, and
    the documents built where they are written."""
    from ..operators import observations as O
    dealt = (O.keyed_messages(enriched, keep).hint("rebalance", *OBSERVATION_PARTITIONS)
             .sortWithinPartitions(*OBSERVATION_PARTITIONS, "id"))
    return write_table(O.build_observations(dealt, keep=keep), path, mode=mode, rebalance=False,
                       partition_cols=OBSERVATION_PARTITIONS, options=STORE_OPTIONS)


def export_documents(obs: DataFrame, path: str, mode: str = "overwrite", extra: tuple = (),
                     compression: str = "none") -> None:
    """Observation documents as JSON text (one per line), same partition layout;
    ``extra`` names further columns of the document. ``compression``: a codec of Spark's
    text files; a compressed file is read by one task, so files are kept to ``EXPORT_ROWS``."""
    from ..operators.observations import OBSERVATION_FIELDS
    present = [c for c in OBSERVATION_FIELDS if c in obs.columns]
    docs = obs.select(*OBSERVATION_PARTITIONS,
                      F.to_json(F.struct(*present, *extra)).alias("value"))
    w = docs.hint("rebalance", *OBSERVATION_PARTITIONS).write.mode(mode)
    if compression != "none":
        w = w.option("compression", compression).option("maxRecordsPerFile", str(EXPORT_ROWS))
    w.partitionBy(*OBSERVATION_PARTITIONS).text(path)


def export_by_processing_date(obs: DataFrame, path: str) -> None:
    """Documents of the basic variant: below their processing date (year, month,
    day folders), without a type level."""
    from ..operators.observations import OBSERVATION_FIELDS
    present = [c for c in OBSERVATION_FIELDS if c in obs.columns]
    day = F.date_format("observation_date", "yyyy/MM/dd")
    docs = obs.select(*[F.split_part(day, F.lit("/"), F.lit(i + 1)).alias(n)
                        for i, n in enumerate(("year", "month", "day"))],
                      F.to_json(F.struct(*present)).alias("value"))
    docs.hint("rebalance", "year", "month", "day").write.mode("append") \
        .partitionBy("year", "month", "day").text(path)


def write_alerts(notifications: DataFrame, path: str) -> int | None:
    """Alert notifications table (what the notifier publishes), by date."""
    return write_table(notifications, path, mode="append", partition_cols=["date"])


def write_metrics(metrics: DataFrame, path: str) -> int | None:
    """Metric rows (name, value, unit, ...), appended."""
    return write_table(metrics.withColumn("recorded_at", F.current_timestamp()), path,
                       mode="append")


def compact(spark, path: str, out_path: str, partition_cols=()) -> int | None:
    """Small-file compaction: rewrite a table (e.g. a streaming sink with
    one file per task and micro-batch) into a few right-sized files per
    partition. Writes to ``out_path``; swapping locations is left to the
    storage layer (reading and overwriting one path in a job is unsafe)."""
    return write_table(spark.read.parquet(path), out_path, partition_cols=partition_cols)
