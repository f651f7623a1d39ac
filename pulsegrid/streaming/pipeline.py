"""Structured Streaming pipelines (the device -> Observation path).

    landing JSON ──> bronze (raw copy + parsed message, by channel / ingest date)
                       ├──> enriched messages (validated, alerts, severity) ──> observations
                       └──> quarantine (unparseable, unsubscribed)       ├──> alert notifications
                                                                         └──> hourly partial states

* The text is read and parsed once, into bronze; enriched messages and quarantine
  read the parsed columns from there.
* Every stage is a separate query with its own checkpoint, so each can be
  restarted independently; a restart replays from the checkpoint.
* Parquet file sinks are exactly-once (the sink's commit log); the
  ``foreachBatch`` sinks write one folder per batch id in overwrite mode, so
  a replayed batch replaces its own output instead of duplicating it.
* Observation ids are deterministic. A message the producer sends again, in
  the same batch or months later, is found by its id in the days of the store that
  the batch touches; there is no watermark, so no row is ever too late.
* ``trigger(availableNow=True)`` gives the incremental-batch behaviour: each
  run processes only files not seen before, then stops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vocab import TOPIC_FILTERS
from ..operators import enrich, gold
from ..operators import observations as O
from ..schemas import RAW_MESSAGE, RAW_MESSAGE_WITH_CORRUPT, ROLLUPS
from ..session import scratch_path
from ..sinks.tables import OBSERVATION_PARTITIONS, STORE_OPTIONS, table_exists
from ..sources import files, topics


@dataclass
class StreamPaths:
    landing: str
    root: str

    def sink(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def new_paths(spark: SparkSession, landing: str) -> StreamPaths:
    return StreamPaths(landing, scratch_path(spark, "stream"))


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval or "10 seconds")


def raw_stream(spark: SparkSession, landing: str,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Landing JSON lines as a stream: raw text + parsed message columns."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    text = (r.option("recursiveFileLookup", "true").load(landing)
            .where(F.trim("value") != "")
            .select(F.col("value").alias("raw"), F.col("value").alias("_body"),
                    F.col("_metadata.file_path").alias("_path")))
    parsed = files.parse_json_column(text, "_body", RAW_MESSAGE_WITH_CORRUPT)
    # a published message names no topic: its landing folders do
    return parsed.withColumn("topic", topics.landed_topic(F.col("topic"), F.col("_path"))).drop("_path")


def enriched_stream(raw: DataFrame, rules: str = "full", filters=TOPIC_FILTERS) -> DataFrame:
    """Readable messages on the subscribed topics -> enriched envelope."""
    msgs = topics.subscribe(files.valid_rows(raw).drop("raw"), filters)
    return enrich.enrich_messages(msgs, rules=rules)


def enriched_schema(spark: SparkSession):
    """Schema of the enriched table, known before anything is written."""
    raw = spark.createDataFrame([], RAW_MESSAGE_WITH_CORRUPT).withColumn("raw", F.lit(""))
    return enriched_stream(raw).schema


def bronze_rows(raw: DataFrame) -> DataFrame:
    """Raw copy keyed by channel and arrival date (device id stays a column), with the
    parsed message beside its text."""
    parsed = F.col(files.CORRUPT).isNull()
    topic = F.col("topic")  # of an unreadable record: what its folder says
    return raw.select(
        "raw", parsed.alias("parsed"), F.when(parsed, F.col("deviceId")).alias("deviceId"),
        topic.alias("topic"),
        F.when(parsed, F.struct(*[c for c in RAW_MESSAGE.names if c != "topic"])).alias("message"),
        F.coalesce(topics.topic_segment(topic, 2), F.lit("unknown")).alias("channel"),
        F.current_date().alias("ingest_date"),
        F.unix_millis(F.current_timestamp()).alias("arrival_ms"))


def start_bronze(raw: DataFrame, paths: StreamPaths, available_now: bool = True,
                 interval: str | None = None) -> StreamingQuery:
    w = (bronze_rows(raw).writeStream.format("parquet").partitionBy("channel", "ingest_date")
         .option("path", paths.sink("bronze"))
         .option("checkpointLocation", paths.checkpoint("bronze")))
    return _trigger(w, available_now, interval).start()


def _sink_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None) -> DataFrame:
    """A sink's table as a stream (reads its commit log); it may still be empty."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
    return r.parquet(path)


def bronze_source(spark: SparkSession, paths: StreamPaths,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Bronze as a stream with the columns of ``raw_stream``: nothing is parsed again."""
    empty = spark.createDataFrame([], RAW_MESSAGE_WITH_CORRUPT).withColumn("raw", F.lit(""))
    b = _sink_stream(spark, paths.sink("bronze"), bronze_rows(empty).schema, max_files_per_trigger)
    return b.select("raw", *[F.col("topic") if c == "topic" else F.col(f"message.{c}").alias(c)
                             for c in RAW_MESSAGE.names],
                    F.when(~F.col("parsed"), F.col("raw")).alias(files.CORRUPT))


def start_enriched(raw: DataFrame, paths: StreamPaths, available_now: bool = True,
                   interval: str | None = None, rules: str = "full", filters=TOPIC_FILTERS) -> StreamingQuery:
    w = (enriched_stream(raw, rules, filters).writeStream.format("parquet")
         .option("path", paths.sink("enriched"))
         .option("checkpointLocation", paths.checkpoint("enriched")))
    return _trigger(w, available_now, interval).start()


def refusal(filters=TOPIC_FILTERS) -> F.Column:
    """Why a parsed record goes no further; null if it does."""
    return (F.when(F.col(files.CORRUPT).isNotNull(), F.lit("unparseable"))
            .when(~topics.topic_matches(F.col("topic"), filters), F.lit("unsubscribed")))


def start_quarantine(raw: DataFrame, paths: StreamPaths, available_now: bool = True,
                     interval: str | None = None, filters=TOPIC_FILTERS) -> StreamingQuery:
    """Records that go no further, with a reason, their topic and the batch id: unparseable
    text, and messages on no subscribed topic. ``plans/replay.py`` tries them again."""
    bad = raw.select("raw", "topic", refusal(filters).alias("reason")).where(F.col("reason").isNotNull())
    target = paths.sink("quarantine")

    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{target}/batch={batch_id}"))
    w = (bad.writeStream.foreachBatch(write)
         .option("checkpointLocation", paths.checkpoint("quarantine")))
    return _trigger(w, available_now, interval).start()


def enriched_source(spark: SparkSession, paths: StreamPaths,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """The enriched-message table as a stream (reads the sink's commit log); the
    schema is declared, so the sink may still be empty."""
    return _sink_stream(spark, paths.sink("enriched"), enriched_schema(spark), max_files_per_trigger)


def not_stored(obs: DataFrame, store: str, batch_id: int) -> DataFrame:
    """Each Observation (or its keyed message) once, without those that other batches of
    the store hold.

    Equal ids lie in the same type and date, so only the id column of the partitions
    that the batch touches is read; its own folder, of an earlier try, does not count."""
    spark = obs.sparkSession
    obs = obs.dropDuplicates(["id"])
    if not table_exists(spark, store):
        return obs
    touched = obs.select(*OBSERVATION_PARTITIONS).distinct().collect()
    held = spark.read.schema("id string, batch long, device_type string, observation_date date").parquet(store)
    kind, day = (sorted({r[i] for r in touched if r[i] is not None}) for i in (0, 1))
    near = lambda c, values, null: (F.col(c).isin(values) if values else F.lit(False)) | (
        F.col(c).isNull() if null else F.lit(False))
    held = held.where((F.col("batch") != batch_id) & near("device_type", kind, any(r[0] is None for r in touched))
                      & near("observation_date", day, any(r[1] is None for r in touched)))
    return obs.join(held.select("id"), "id", "left_anti").select(obs.columns)


def start_observations(enriched: DataFrame, paths: StreamPaths, available_now: bool = True,
                       interval: str | None = None) -> StreamingQuery:
    """Enriched messages -> Observations, partitioned by type and event date, each
    message once whenever it is sent again.

    Each micro-batch is rebalanced on the partition columns before it is written
    under its batch id (a replay overwrites it): a hot (type, date) is split over
    as many tasks as its volume needs, small ones share one. Copies are looked for and
    rows dealt and sorted as messages; the documents are built where they are written.
    """
    target = paths.sink("observations")

    def write(batch: DataFrame, batch_id: int):
        dealt = (not_stored(batch, target, batch_id).hint("rebalance", *OBSERVATION_PARTITIONS)
                 .sortWithinPartitions(*OBSERVATION_PARTITIONS))
        obs = O.build_observations(dealt).withColumn("processed_at", F.current_timestamp())
        (obs.write.mode("overwrite").option("compression", STORE_OPTIONS["compression"])
         .partitionBy(*OBSERVATION_PARTITIONS).parquet(f"{target}/batch={batch_id}"))
    w = (O.keyed_messages(enriched).writeStream.foreachBatch(write)
         .option("checkpointLocation", paths.checkpoint("observations")))
    return _trigger(w, available_now, interval).start()


def start_alerts(enriched: DataFrame, paths: StreamPaths, available_now: bool = True,
                 interval: str | None = None) -> StreamingQuery:
    """Messages with alerts -> notification rows (idempotent per batch)."""
    flat = enrich.flatten_messages(enriched)
    notes = enrich.notifications(flat).select("message_id", "device_id", "alert_type",
                                              "severity", "subject", "alerts_sent",
                                              "alert_types")
    target = paths.sink("alerts")

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    w = (notes.writeStream.foreachBatch(write)
         .option("checkpointLocation", paths.checkpoint("alerts")))
    return _trigger(w, available_now, interval).start()


def start_hourly(enriched: DataFrame, paths: StreamPaths, available_now: bool = True,
                 interval: str | None = None) -> StreamingQuery:
    """Hourly trends as mergeable partial states: every micro-batch writes its own
    under its batch id. No watermark and no state, so a late row, or one without
    a time, counts whenever it comes."""
    target = paths.sink("hourly")

    def write(batch: DataFrame, batch_id: int):
        (gold.partial_state(batch, ROLLUPS["hourly_trends"])
         .write.mode("overwrite").parquet(f"{target}/batch={batch_id}"))
    w = (enrich.flatten_messages(enriched).writeStream.foreachBatch(write)
         .option("checkpointLocation", paths.checkpoint("hourly")))
    return _trigger(w, available_now, interval).start()


def start_scoring(enriched: DataFrame, paths: StreamPaths, available_now: bool = True,
                  interval: str | None = None) -> StreamingQuery:
    """Threshold scoring per message: anomaly rows and the two metric rows
    (AnomalyCount, RiskScore) per evaluation, written per batch id."""
    from ..operators import anomaly
    scored = anomaly.score_readings(enriched)
    target = paths.sink("scoring")

    def write(batch: DataFrame, batch_id: int):
        batch = batch.select("messageId", "patient_id", "n_anomalies", "risk_score",
                             "alert_level", "readings_analyzed", "anomalies", "evaluated_at")
        metrics = anomaly.anomaly_metric_rows(batch, "messageId", "patient_id", "evaluated_at")
        (metrics.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{target}/metrics/batch={batch_id}"))
        (anomaly.explode_anomalies(batch, "messageId", "patient_id")
         .write.mode("overwrite").parquet(f"{target}/anomalies/batch={batch_id}"))
    w = (scored.writeStream.foreachBatch(write)
         .option("checkpointLocation", paths.checkpoint("scoring")))
    return _trigger(w, available_now, interval).start()


def hourly_trends(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """The trends over all batches so far: the same columns as in batch."""
    rollup = ROLLUPS["hourly_trends"]
    return gold.finish(gold.merge_state(spark.read.parquet(paths.sink("hourly")), rollup), rollup)


def run_to_completion(*queries: StreamingQuery) -> None:
    """Wait for every query; a failed one raises its own error."""
    for q in queries:
        q.awaitTermination()


def run_ingest(spark: SparkSession, landing: str, paths: StreamPaths | None = None,
               bronze: bool = True, quarantine: bool = True, filters=TOPIC_FILTERS) -> StreamPaths:
    """Landing -> bronze -> enriched (and quarantine); availableNow, waits for completion.
    Without bronze the stages read the landing files themselves."""
    paths = paths or new_paths(spark, landing)
    if bronze:
        run_to_completion(start_bronze(raw_stream(spark, landing), paths))
    source = lambda: bronze_source(spark, paths) if bronze else raw_stream(spark, landing)
    qs = [start_enriched(source(), paths, filters=filters)]
    if quarantine:
        qs.append(start_quarantine(source(), paths, filters=filters))
    run_to_completion(*qs)
    return paths


def main(argv=None) -> int:
    """spark-submit entry: python -m pulsegrid.streaming.pipeline --landing L --root R
    [--continuous 30s]. Without --continuous each run processes the new files
    and stops (availableNow)."""
    import argparse

    from ..session import build_session
    ap = argparse.ArgumentParser(description="device message streaming pipeline")
    ap.add_argument("--landing", required=True)
    ap.add_argument("--root", required=True, help="sinks and checkpoints root")
    ap.add_argument("--continuous", default=None, help="processing-time trigger interval")
    ap.add_argument("--max-files-per-trigger", type=int, default=None)
    a = ap.parse_args(argv)
    spark = build_session(app="pulsegrid-stream")
    paths = StreamPaths(a.landing, a.root)
    once = a.continuous is None
    if once:
        run_ingest(spark, a.landing, paths)
        run_to_completion(start_observations(enriched_source(spark, paths), paths),
                          start_alerts(enriched_source(spark, paths), paths),
                          start_scoring(enriched_source(spark, paths), paths),
                          start_hourly(enriched_source(spark, paths), paths))
        return 0
    start_bronze(raw_stream(spark, a.landing, a.max_files_per_trigger), paths, False, a.continuous)
    start_enriched(bronze_source(spark, paths), paths, False, a.continuous)
    start_quarantine(bronze_source(spark, paths), paths, False, a.continuous)
    for stage in (start_observations, start_alerts, start_scoring, start_hourly):
        stage(enriched_source(spark, paths), paths, False, a.continuous)
    spark.streams.awaitAnyTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
