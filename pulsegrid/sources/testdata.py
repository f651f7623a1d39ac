"""Device messages and patients derived from the driver's tables.

``events`` becomes a stream of device messages (one per event) and
``customer`` becomes the patient registry. Both mappings are deterministic
column arithmetic, so the same rows come out of Spark and of the SQL oracle.
Absent vitals are absent keys in the message's readings MAP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import LOINC_COMPONENTS


def _case(x: Column, cases: dict, default) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out.otherwise(default)


def readings_from_events(events: DataFrame) -> DataFrame:
    """Flat readings: event_id, ts, device_id, device_type, topic, patient_id, 7 vitals."""
    e = events.select(
        "event_id", "ts", "user_id",
        (F.col("user_id") * 2 + F.col("event_id") % 2).alias("dn"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))
    eid, uid, dn, k = F.col("event_id"), F.col("user_id"), F.col("dn"), F.col("k")
    dbl = lambda c: c.cast("double")

    device_type = _case(dn % 5, {0: "smartwatch", 1: "pulse_oximeter", 2: "bp monitor",
                                 3: "glucose_meter"}, "thermometer")
    topic = F.concat(F.when(dn % 5 < 2, F.lit("iomt/wearables/device-"))
                     .otherwise(F.lit("iomt/home-health/device-")), dn.cast("string"))
    patient = F.when(uid % 29 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("patient-"), uid.cast("string")))
    hr = (F.when(eid % 11 == 0, F.lit(None).cast("double"))
          .when(dn % 37 == 0, dbl(38 + (eid * 7 + k) % 120))
          .otherwise(dbl(50 + uid % 50 + (eid * 7 + k) % 16
                         + _case(eid % 23, {1: 65, 2: -25}, 0))))
    o2 = F.when(eid % 13 == 0, F.lit(None).cast("double")).otherwise(dbl(
        96 + (eid * 5 + k) % 5 - _case(eid % 29, {3: 12, 4: 6, 5: 4}, 0)
        - F.when(uid % 31 == 7, 4).when(uid % 31 == 8, 8).otherwise(0)))
    sys_bp = F.when(eid % 7 == 0, F.lit(None).cast("double")).otherwise(dbl(
        100 + (eid * 11 + k) % 35 + _case(eid % 31, {6: 70, 7: 30, 8: -25}, 0)
        + _case(uid % 37, {5: 40, 6: -35}, 0)))
    dia_bp = F.when((eid % 7 == 0) | (eid % 17 == 0), F.lit(None).cast("double")).otherwise(
        dbl(65 + (eid * 3 + k) % 22 + _case(eid % 31, {9: 50, 10: 15, 11: -18}, 0)))
    temp = F.when(eid % 5 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(36.2) + dbl((eid * 13 + k) % 10) / F.lit(10.0)
        + _case(eid % 41, {12: F.lit(3.0), 13: F.lit(-2.0), 14: F.lit(1.0)}, F.lit(0.0)))
    glu = F.when(eid % 3 != 0, F.lit(None).cast("double")).otherwise(dbl(
        80 + (eid * 17 + k) % 60 + _case(eid % 43, {15: 90, 16: -25}, 0)))
    rr = F.when(eid % 4 == 0, F.lit(None).cast("double")).otherwise(dbl(
        12 + (eid * 19 + k) % 9 + _case(eid % 47, {17: 20, 18: -7, 19: 6}, 0)))

    return fixture_barrier(e.select(
        "event_id", "ts",
        F.concat(F.lit("device-"), dn.cast("string")).alias("device_id"),
        device_type.alias("device_type"), topic.alias("topic"),
        patient.alias("patient_id"),
        hr.alias("heart_rate"), o2.alias("blood_oxygen"), sys_bp.alias("systolic_bp"),
        dia_bp.alias("diastolic_bp"), temp.alias("temperature"),
        glu.alias("blood_glucose"), rr.alias("respiratory_rate")))


def fixture_barrier(df: DataFrame) -> DataFrame:
    """Stop predicate pushdown at the end of a derived fixture.

    The fixture is one large expression tree over ``events``; a downstream
    filter pushed through it would be rewritten in terms of that tree and
    evaluate it once per reference (no common-subexpression elimination in
    a pushed predicate). A one-row generator is a narrow, codegen'd node that
    filters cannot pass, so the mapping runs exactly once per row -- the
    same shape as a real source, whose columns are stored, not derived.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 UTC text with microseconds and a 'Z' suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def messages_from_readings(readings: DataFrame) -> DataFrame:
    """Nested device messages (the published JSON shape) from flat readings.

    ``messageId`` carries the event id; absent vitals are absent map keys.
    """
    from ..functions.alerts import compact
    entries = [F.when(F.col(col).isNotNull(),
                      F.struct(F.lit(key).alias("key"), F.col(col).alias("value")))
               for key, col, *_ in LOINC_COMPONENTS]
    readings_map = F.map_from_entries(compact(entries, "struct<key:string,value:double>"))
    return fixture_barrier(readings.select(
        F.col("event_id"),
        F.col("topic"),
        F.col("device_id").alias("deviceId"),
        F.col("device_type").alias("deviceType"),
        F.col("patient_id").alias("patientId"),
        iso_timestamp(F.col("ts")).alias("timestamp"),
        readings_map.alias("readings"),
        F.col("event_id").cast("string").alias("messageId")))


def messages_from_events(events: DataFrame) -> DataFrame:
    return messages_from_readings(readings_from_events(events))


def patients_from_customer(customer: DataFrame, *extra: Column) -> DataFrame:
    """Patient registry rows; ``extra`` columns (over customer) are appended."""
    ck = F.col("c_custkey")
    null_int = F.lit(None).cast("int")
    null_dbl = F.lit(None).cast("double")
    return customer.select(
        F.concat(F.lit("patient-"), ck.cast("string")).alias("patient_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation_key"),
        F.when(ck % 2 == 0, F.lit("female")).otherwise(F.lit("male")).alias("gender"),
        F.when(ck % 13 == 0, null_int).otherwise((25 + (ck * 7) % 65).cast("int")).alias("age"),
        F.when(ck % 17 == 0, null_int).otherwise(((ck * 5) % 6).cast("int"))
        .alias("chronic_conditions"),
        F.when(ck % 19 == 0, null_int).otherwise(((ck * 3) % 4).cast("int"))
        .alias("recent_hospitalizations"),
        F.when(ck % 9 == 0, null_dbl).otherwise(((ck * 3) % 11).cast("double") / F.lit(10.0))
        .alias("medication_adherence"),
        F.when(ck % 11 == 0, null_dbl).otherwise(((ck * 3) % 25).cast("double"))
        .alias("heart_rate_variance"),
        F.when(ck % 14 == 0, null_dbl).otherwise(((ck * 7) % 30).cast("double"))
        .alias("bp_variance"), *extra)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_BUILT: dict = {}


def _memo(kind: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Reuse the built fixture plan per session and folder (plans are immutable)."""
    key = (kind, id(spark), sf_dir)
    df = _BUILT.get(key)
    if df is None or df.sparkSession is not spark:
        df = _BUILT[key] = build()
    return df


def load_messages(spark: SparkSession, sf_dir: str, events: str | None = None) -> DataFrame:
    """Messages of all events, or of those that the condition ``events`` keeps: it is applied
    to the table, as no filter on messages gets past the mapping."""
    def build():
        table = load_table(spark, sf_dir, "events")
        return messages_from_events(table.where(events) if events else table)
    return _memo(f"messages:{events or ''}", spark, sf_dir, build)


def load_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("patients", spark, sf_dir,
                 lambda: patients_from_customer(load_table(spark, sf_dir, "customer")))


def sparse_messages(events: DataFrame) -> DataFrame:
    """Messages with some fields left out, to exercise message defaults:
    no deviceId every 53rd event, no deviceType every 19th, no timestamp every
    61st, no readings every 67th."""
    m = messages_from_events(events)
    eid = F.col("event_id")

    def drop_when(cond, name, dtype):
        return F.when(cond, F.lit(None).cast(dtype)).otherwise(F.col(name))
    return m.withColumns({
        "deviceId": drop_when(eid % 53 == 0, "deviceId", "string"),
        "deviceType": drop_when(eid % 19 == 0, "deviceType", "string"),
        "timestamp": drop_when(eid % 61 == 0, "timestamp", "string"),
        "readings": drop_when(eid % 67 == 0, "readings", "map<string,double>"),
    })


MESSAGE_JSON_FIELDS = ["deviceId", "deviceType", "patientId", "timestamp", "readings",
                       "messageId", "topic"]


def message_lines(msgs: DataFrame, corrupt_every: int = 97) -> DataFrame:
    """One JSON text line per message; every ``corrupt_every``-th message
    (by message id) is cut in half to exercise quarantine."""
    body = F.to_json(F.struct(*[F.col(c) for c in MESSAGE_JSON_FIELDS]))
    cut = F.col("event_id") % corrupt_every == 0 if corrupt_every else F.lit(False)
    line = F.when(cut, F.substring(body, 1, F.length(body) / 2)).otherwise(body)
    return msgs.select(F.col("event_id"), line.alias("value"))


def write_published_files(msgs: DataFrame, path: str, corrupt_every: int = 0) -> str:
    """Land messages the way devices publish them: no topic in the body, files
    below <channel>/<device group>/ (a few groups, not a folder per device)."""
    body = F.to_json(F.struct(*[F.col(c) for c in MESSAGE_JSON_FIELDS if c != "topic"]))
    cut = F.col("event_id") % corrupt_every == 0 if corrupt_every else F.lit(False)
    line = F.when(cut, F.substring(body, 1, F.length(body) / 2)).otherwise(body)
    for channel in ("wearables", "home-health"):
        (msgs.where(F.split_part("topic", F.lit("/"), F.lit(2)) == channel).select(line.alias("value"))
         .write.mode("overwrite").text(f"{path}/{channel}/fleet"))
    return path


def write_message_files(msgs: DataFrame, path: str, corrupt_every: int = 97,
                        files: int | None = None) -> str:
    """Land device messages as JSON-lines files (the raw landing area), one
    file per input partition; ``files`` forces a count (small tests only)."""
    lines = message_lines(msgs, corrupt_every).select("value")
    if files:
        lines = lines.repartition(files)
    lines.write.mode("overwrite").text(path)
    return path
