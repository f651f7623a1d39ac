"""Device history over bronze: committed stream files clustered by device.

The bronze stream leaves small files by channel and arrival date. ``cluster`` takes the
files that the sink has committed since the last run and rewrites them into files
ordered by device and arrival -- a device that sends a third of all messages simply spans
several -- and ``device_index`` keeps each file's range of devices, so that the history of
one device opens a few files instead of a folder per device existing for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.runlog import RunLog
from ..sinks.storeindex import StoreIndex
from ..sinks.tables import write_table
from ..sources import topics
from .pipeline import StreamPaths

ROWS_PER_FILE = 1_000_000


def device_key() -> Column:
    """The device of a bronze row; of an unreadable one what its topic says."""
    return F.coalesce(F.col("deviceId"), F.nullif(topics.topic_segment(F.col("topic"), 3), F.lit("")))


def cluster(spark: SparkSession, paths: StreamPaths, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Rewrite the bronze files committed since the last run; returns their rows. A run
    that stopped is repeated under its number and overwrites its folder."""
    log = RunLog(spark, paths.sink("bronze_runs"))
    run = log.open_run()
    number = run.number if run else log.begin("cluster")
    bronze = paths.sink("bronze")
    # through the sink's commit log: files of a failed batch are not listed
    names = log.take_names(number, "bronze", spark.read.parquet(bronze).inputFiles())
    n = 0
    if names:
        rows = spark.read.option("basePath", bronze).parquet(*names).withColumn("device", device_key())
        parts = max(-(-rows.count() // rows_per_file), 1)
        ordered = rows.repartitionByRange(parts, "device", "arrival_ms", F.xxhash64("raw")).sortWithinPartitions(
            "device", "arrival_ms")
        n = write_table(ordered, f"{paths.sink('bronze_by_device')}/run={number}")
    log.mark(number, "commit", files=len(names), rows=n)
    return n


def device_index(spark: SparkSession, paths: StreamPaths) -> StoreIndex:
    return StoreIndex(spark, paths.sink("bronze_by_device"), paths.sink("bronze_index"),
                      {"device": F.col("device"), "arrival": F.col("arrival_ms")}, key="arrival")


def device_history(index: StoreIndex, device: str) -> tuple[DataFrame, int]:
    """All bronze rows of a device, and how many files they were read from."""
    paths = [r.path for r in index.files().where(index.may_hold(equal={"device": device})).select("path").collect()]
    if not paths:
        return index.page(1, F.lit(False), F.lit(False))[0], 0
    return index.read(paths).where(F.col("device") == device), len(paths)


def main(argv=None) -> int:
    """spark-submit entry: python -m pulsegrid.streaming.bronze --landing L --root R"""
    import argparse

    from ..session import build_session
    ap = argparse.ArgumentParser(description="cluster committed bronze files by device")
    ap.add_argument("--landing", required=True)
    ap.add_argument("--root", required=True, help="sinks and checkpoints root")
    ap.add_argument("--rows-per-file", type=int, default=ROWS_PER_FILE)
    a = ap.parse_args(argv)
    spark = build_session(app="pulsegrid-bronze")
    paths = StreamPaths(a.landing, a.root)
    rows = cluster(spark, paths, a.rows_per_file)
    print(f"{rows} rows clustered, {device_index(spark, paths).refresh()} new files indexed")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
