"""Explicit schemas for every source (no inference at read time)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()

# Device message as published (plus the fields the enrichment adds, which an
# already-enriched message carries). ``readings`` is a MAP so that an absent
# key and a null value stay distinguishable.
RAW_MESSAGE = T.StructType([
    T.StructField("deviceId", S),
    T.StructField("deviceType", S),
    T.StructField("patientId", S),
    T.StructField("timestamp", S),
    T.StructField("readings", T.MapType(S, D)),
    T.StructField("alerts", T.ArrayType(S)),
    T.StructField("alertSeverity", S),
    T.StructField("metadata", T.MapType(S, S)),
    T.StructField("messageId", S),
    T.StructField("topic", S),
])

RAW_MESSAGE_WITH_CORRUPT = T.StructType(
    RAW_MESSAGE.fields + [T.StructField("_corrupt_record", S)])

_CODING = T.StructType([
    T.StructField("system", S), T.StructField("code", S), T.StructField("display", S)])
_IDENT = T.StructType([T.StructField("system", S), T.StructField("value", S)])
_CONCEPT = T.StructType([
    T.StructField("coding", T.ArrayType(_CODING)), T.StructField("text", S)])
_QUANTITY = T.StructType([
    T.StructField("value", D), T.StructField("unit", S),
    T.StructField("system", S), T.StructField("code", S)])

OBSERVATION = T.StructType([
    T.StructField("resourceType", S),
    T.StructField("id", S),
    T.StructField("meta", T.StructType([
        T.StructField("versionId", S), T.StructField("lastUpdated", S),
        T.StructField("profile", T.ArrayType(S))])),
    T.StructField("identifier", T.ArrayType(_IDENT)),
    T.StructField("status", S),
    T.StructField("category", T.ArrayType(T.StructType([
        T.StructField("coding", T.ArrayType(_CODING))]))),
    T.StructField("effectiveDateTime", S),
    T.StructField("issued", S),
    T.StructField("device", T.StructType([
        T.StructField("identifier", _IDENT), T.StructField("display", S)])),
    T.StructField("subject", T.StructType([
        T.StructField("reference", S), T.StructField("identifier", _IDENT)])),
    T.StructField("component", T.ArrayType(T.StructType([
        T.StructField("code", _CONCEPT), T.StructField("valueQuantity", _QUANTITY)]))),
    T.StructField("interpretation", T.ArrayType(_CONCEPT)),
])

OBSERVATION_WITH_CORRUPT = T.StructType(
    OBSERVATION.fields + [T.StructField("_corrupt_record", S)])

PATIENT = T.StructType([
    T.StructField("patient_id", S),
    T.StructField("name", S),
    T.StructField("nation_key", T.IntegerType()),
    T.StructField("gender", S),
    T.StructField("age", T.IntegerType()),
    T.StructField("chronic_conditions", T.IntegerType()),
    T.StructField("recent_hospitalizations", T.IntegerType()),
    T.StructField("medication_adherence", D),
    T.StructField("heart_rate_variance", D),
    T.StructField("bp_variance", D),
])

ANOMALY = T.StructType([
    T.StructField("metric", S), T.StructField("value", D),
    T.StructField("severity", S), T.StructField("message", S)])

QUARANTINE = T.StructType([
    T.StructField("raw", S), T.StructField("reason", S),
    T.StructField("batch_id", T.LongType())])


@dataclass(frozen=True)
class Rollup:
    """A gold table: keys, entities it counts, and outputs (name, kind, column)."""
    keys: tuple[str, ...]
    entities: tuple[str, ...]
    outputs: tuple[tuple[str, str, str | None], ...]


# FIXED VALUES: column names and meaning of the gold tables, as their readers
# expect them.
ROLLUPS = {
    "patient_summary": Rollup(
        keys=("patient_reference",), entities=("device_id",),
        outputs=(
            ("total_observations", "count", "observation_id"),
            ("first_reading", "least", "effective_timestamp"),
            ("last_reading", "greatest", "effective_timestamp"),
            ("avg_heart_rate", "mean", "heart_rate"),
            ("min_heart_rate", "least", "heart_rate"),
            ("max_heart_rate", "greatest", "heart_rate"),
            ("avg_blood_oxygen", "mean", "blood_oxygen"),
            ("min_blood_oxygen", "least", "blood_oxygen"),
            ("avg_systolic_bp", "mean", "systolic_bp"),
            ("avg_diastolic_bp", "mean", "diastolic_bp"),
            ("avg_blood_glucose", "mean", "blood_glucose"),
            ("unique_devices", "distinct", "device_id"))),
    "device_analytics": Rollup(
        keys=("device_id", "device_type"), entities=("patient_id",),
        outputs=(
            ("total_readings", "rows", None),
            ("first_seen", "least", "ts"),
            ("last_seen", "greatest", "ts"),
            ("unique_patients", "distinct", "patient_id"),
            ("total_alerts", "total", "alert_count"),
            ("critical_alerts", "total", "has_critical_alert"),
            ("avg_heart_rate_reading", "mean", "heart_rate"),
            ("heart_rate_stddev", "spread", "heart_rate"))),
    "hourly_trends": Rollup(
        keys=("date", "hour", "device_type"), entities=("device_id", "patient_id"),
        outputs=(
            ("reading_count", "rows", None),
            ("avg_heart_rate", "mean", "heart_rate"),
            ("avg_blood_oxygen", "mean", "blood_oxygen"),
            ("avg_systolic_bp", "mean", "systolic_bp"),
            ("avg_diastolic_bp", "mean", "diastolic_bp"),
            ("total_alerts", "total", "alert_count"),
            ("active_devices", "distinct", "device_id"),
            ("active_patients", "distinct", "patient_id"))),
}
