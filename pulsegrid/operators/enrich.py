"""Message -> enriched reading (silver).

All operators here are row-local (narrow): they add no shuffle and run the
same on a batch DataFrame and on a streaming one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alerts as A
from ..functions.vocab import LOINC_COMPONENTS, NOTIFY_ALERT_TYPE
from ..schemas import RAW_MESSAGE

RAW_FIELDS = {f.name for f in RAW_MESSAGE.fields} | {"_corrupt_record"}


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _opt(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if _has(df, name) else F.lit(None).cast(dtype)


def apply_message_defaults(msgs: DataFrame) -> DataFrame:
    """deviceId / deviceType -> 'unknown', timestamp -> now (ISO text),
    readings / metadata -> empty maps. Other columns pass through."""
    now_iso = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return msgs.withColumns({
        "deviceId": F.coalesce(_opt(msgs, "deviceId", "string"), F.lit("unknown")),
        "deviceType": F.coalesce(_opt(msgs, "deviceType", "string"), F.lit("unknown")),
        "patientId": _opt(msgs, "patientId", "string"),
        "timestamp": F.coalesce(_opt(msgs, "timestamp", "string"), now_iso),
        "readings": F.coalesce(_opt(msgs, "readings", "map<string,double>"),
                               F.create_map().cast("map<string,double>")),
        "metadata": F.coalesce(_opt(msgs, "metadata", "map<string,string>"),
                               F.create_map().cast("map<string,string>")),
    })


def message_alerts(msgs: DataFrame, rules: str = "full", given: bool = True) -> Column:
    """Alerts of a message; with ``given`` those it carries come first (a message
    that was enriched before), without it they are always computed."""
    r = F.col("readings")
    if rules == "basic":
        computed = A.validate_readings_basic(r["heartRate"], r["bloodOxygen"])
    else:
        computed = A.validate_readings(r["heartRate"], r["bloodOxygen"], r["systolicBP"],
                                       r["diastolicBP"], r["temperature"], r["bloodGlucose"])
    if given and _has(msgs, "alerts"):
        return F.coalesce(F.col("alerts"), computed)
    return computed


def enrich_messages(msgs: DataFrame, rules: str = "full",
                    request_id: Column | None = None) -> DataFrame:
    """Enriched message envelope: + alerts, alertSeverity, processedAt, request id.

    Alerts are computed from the readings, whatever the device sent along."""
    m = apply_message_defaults(msgs)
    m = m.withColumn("alerts", message_alerts(m, rules, given=False))
    return m.withColumns({
        "alertSeverity": A.alert_severity(F.col("alerts")),
        "processedAt": F.current_timestamp(),
        "processingRequestId": request_id if request_id is not None
        else F.expr("uuid()"),
    })


def message_summary(enriched: DataFrame) -> DataFrame:
    """Per-message response: deviceId, alerts, severity, message id."""
    return enriched.select("deviceId", "alerts", "alertSeverity", "messageId")


def flatten_messages(msgs: DataFrame, rules: str = "full") -> DataFrame:
    """Message -> one flat enriched reading row.

    Columns: <pass-through>, device_id, device_type, patient_id, ts, 7 vitals,
    alerts, alert_count, alert_types, alert_severity, has_critical_alert,
    date, hour, channel.
    Pass-through = any column that is not part of the message (e.g. event_id).
    """
    produced = {"device_id", "device_type", "patient_id", "ts", "alerts", "channel",
                "message_id", "alert_count", "alert_types", "alert_severity", "date", "hour",
                "has_critical_alert", *[c[1] for c in LOINC_COMPONENTS]}
    keep = [c for c in msgs.columns if c not in RAW_FIELDS and c not in produced]
    r = F.col("readings")
    alerts_col = message_alerts(msgs, rules)
    base = msgs.select(
        *keep,
        F.col("deviceId").alias("device_id"),
        F.col("deviceType").alias("device_type"),
        F.col("patientId").alias("patient_id"),
        F.try_to_timestamp(F.col("timestamp")).alias("ts"),
        *[r[key].alias(col) for key, col, *_ in LOINC_COMPONENTS],
        alerts_col.alias("alerts"),
        _opt(msgs, "messageId", "string").alias("message_id"),
        (F.split_part(F.col("topic"), F.lit("/"), F.lit(2)) if _has(msgs, "topic")
         else F.lit(None).cast("string")).alias("channel"),
    )
    return base.withColumns({
        "alert_count": A.alert_count(F.col("alerts")),
        "alert_types": A.alert_types(F.col("alerts")),
        "alert_severity": A.alert_severity(F.col("alerts")),
        "date": F.to_date(F.col("ts")),
        "hour": F.hour(F.col("ts")),
    }).withColumn("has_critical_alert", A.has_critical_alert(F.col("alert_types")))


def notifications(readings: DataFrame) -> DataFrame:
    """Alert notifications for rows with at least one alert."""
    return (readings.where(F.size(F.col("alerts")) > 0)
            .withColumns({
                "alert_type": F.lit(NOTIFY_ALERT_TYPE),
                "severity": A.notification_severity(F.col("alerts")),
                "subject": A.notification_subject(F.col("alerts")),
                "alerts_sent": F.size(F.col("alerts")),
            }))
