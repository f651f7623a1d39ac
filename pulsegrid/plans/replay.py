"""Replay of quarantined messages, with an attempt ledger and an expiry date.

A replay tries every open quarantined message with the present parser and
subscriptions. What now passes is ``released``: its text goes back to the landing
area, where the stream takes it like any other file. The rest stays ``open`` until
``MAX_TRIES`` replays have failed, is then ``set aside`` with an expiry date, and
``expired`` after it, when its text is dropped and only the key is kept.

The ledger is a snapshot per replay, one row for each different text and topic
(``copies`` counts equal ones). A replay that stopped is repeated under its own number and
overwrites what it left; released messages are never released again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import TOPIC_FILTERS
from ..schemas import RAW_MESSAGE_WITH_CORRUPT
from ..sinks.runlog import RunLog
from ..sinks.tables import table_exists
from ..sources import files, topics
from ..streaming.pipeline import StreamPaths, refusal

# FIXED VALUES: tries before a message is set aside, and days it is then kept
MAX_TRIES = 3
KEEP_DAYS = 14

LEDGER = ("key string, raw string, topic string, reason string, copies long, tries int, state string, "
          "last_tried timestamp, expires_at timestamp")
COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]


def _log(spark: SparkSession, paths: StreamPaths) -> RunLog:
    return RunLog(spark, paths.sink("replay"))


def _snapshot(paths: StreamPaths, number: str) -> str:
    return f"{paths.sink('replay')}/ledger/replay={number}"


def ledger(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """The snapshot of the last finished replay."""
    done = [r.number for r in _log(spark, paths).runs() if r.state == "commit"]
    if not done:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(_snapshot(paths, done[-1]))


def quarantined(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """key, raw, topic, reason, copies of everything ever set into quarantine."""
    if not table_exists(spark, paths.sink("quarantine")):
        return spark.createDataFrame([], "key string, raw string, topic string, reason string, copies long")
    rows = spark.read.schema("raw string, topic string, reason string").parquet(paths.sink("quarantine"))
    key = F.sha2(F.concat_ws("\n", F.coalesce("topic", F.lit("")), "raw"), 256)
    return rows.groupBy(key.alias("key")).agg(*[F.max(c).alias(c) for c in ("raw", "topic", "reason")],
                                              F.count(F.lit(1)).alias("copies"))


def judge(entries: DataFrame, now: datetime, filters=TOPIC_FILTERS, max_tries: int = MAX_TRIES,
          keep_days: int = KEEP_DAYS) -> DataFrame:
    """Ledger rows after one more try at ``now``."""
    tried = files.parse_json_column(entries.withColumn("_body", F.col("raw")).withColumnRenamed("topic", "landed"),
                                    "_body", RAW_MESSAGE_WITH_CORRUPT)
    tried = tried.withColumn("topic", F.coalesce("topic", "landed"))
    at = F.lit(now).cast("timestamp")
    is_open = F.col("state") == "open"
    passes = is_open & refusal(filters).isNull()
    tries = F.col("tries") + is_open.cast("int")
    over = is_open & ~passes & (tries >= max_tries)
    gone = (F.col("state") == "set aside") & (F.col("expires_at") <= at)
    state = (F.when(passes, "released").when(over, "set aside").when(gone, "expired").otherwise(F.col("state")))
    return tried.select(
        "key", F.when(state != "expired", F.col("raw")).alias("raw"), F.col("landed").alias("topic"), "reason", "copies",
        tries.alias("tries"), state.alias("state"), F.when(is_open, at).otherwise(F.col("last_tried")).alias("last_tried"),
        F.when(over, at + F.expr(f"INTERVAL {keep_days} DAYS")).otherwise(F.col("expires_at")).alias("expires_at"))


def replay(spark: SparkSession, paths: StreamPaths, now: datetime, filters=TOPIC_FILTERS,
           max_tries: int = MAX_TRIES, keep_days: int = KEEP_DAYS) -> str:
    """One replay; returns its number."""
    log = _log(spark, paths)
    run = log.open_run()  # a replay that stopped keeps its number, and its time
    if run is None:
        number = log.begin("replay", at=now.isoformat())
    else:
        number = run.number
        now = datetime.fromisoformat(log.facts(number, "begin")["at"])
    before = ledger(spark, paths)
    new = quarantined(spark, paths)
    known = before.select("key", "tries", "state", "last_tried", "expires_at",
                          F.col("raw").alias("old_raw"))
    entries = new.join(known, "key", "full_outer").select(
        "key", F.when(F.coalesce(F.col("state"), F.lit("open")) != "expired", F.coalesce("raw", "old_raw")).alias("raw"),
        "topic", "reason", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("state", F.lit("open")).alias("state"),
        "last_tried", "expires_at")
    place = _snapshot(paths, number)
    judge(entries, now, filters, max_tries, keep_days).select(*COLUMNS).write.mode("overwrite").parquet(place)
    _give_back(spark, paths, place, number, before, filters)
    log.mark(number, "commit", at=now.isoformat())
    return number


def _give_back(spark: SparkSession, paths: StreamPaths, place: str, number: str, before: DataFrame, filters) -> None:
    """The texts released by this replay, into the landing folders of their channels."""
    old = before.where("state = 'released'").select("key")
    out = (spark.read.schema(LEDGER).parquet(place).where("state = 'released'").join(old, "key", "left_anti")
           .withColumn("channel", topics.topic_segment(F.coalesce(
               "topic", F.get_json_object("raw", "$.topic")), 2)))
    # as often as the message was quarantined
    lines = out.select("channel", F.explode(F.array_repeat("raw", F.col("copies").cast("int"))).alias("value"))
    for channel in sorted({f.split("/")[1] for f in filters}):
        lines.where(F.col("channel") == channel).select("value").write.mode("overwrite").text(
            f"{paths.landing}/replay-{number}/{channel}/given-back")


def main(argv=None) -> int:
    """spark-submit entry: python -m pulsegrid.plans.replay --landing L --root R"""
    import argparse
    import json
    from datetime import timezone

    from ..session import build_session
    ap = argparse.ArgumentParser(description="try quarantined messages again")
    ap.add_argument("--landing", required=True)
    ap.add_argument("--root", required=True, help="sinks and checkpoints root")
    a = ap.parse_args(argv)
    spark = build_session(app="pulsegrid-replay")
    paths = StreamPaths(a.landing, a.root)
    replay(spark, paths, datetime.now(timezone.utc))
    print(json.dumps({r["state"]: r["n"] for r in ledger(spark, paths).groupBy("state").agg(
        F.sum("copies").alias("n")).collect()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
