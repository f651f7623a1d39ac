"""FHIR R4 Observation pieces as Column expressions (nested structs, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def coding(system: str, code: str, display: str) -> Column:
    return F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"),
                    F.lit(display).alias("display"))


def now_iso_z() -> Column:
    return F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                    F.lit("Z"))


def observation_id(device_id: Column, timestamp: Column, message_id: Column,
                   readings: Column | None = None) -> Column:
    """Deterministic id: a replayed message maps to the same Observation. Without
    a message id the readings tell messages of one device and second apart."""
    if readings is not None:
        message_id = F.coalesce(message_id.cast("string"), F.to_json(F.map_from_entries(
            F.array_sort(F.map_entries(readings)))))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (device_id, timestamp, message_id)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def meta() -> Column:
    return F.struct(F.lit("1").alias("versionId"), now_iso_z().alias("lastUpdated"),
                    F.array(F.lit(V.OBS_PROFILE)).alias("profile"))


def identifier(obs_id: Column) -> Column:
    return F.array(F.struct(F.lit(V.OBS_IDENTIFIER_SYSTEM).alias("system"),
                            obs_id.alias("value")))


def category() -> Column:
    return F.array(F.struct(F.array(coding(
        V.OBS_CATEGORY_SYSTEM, V.OBS_CATEGORY_CODE, V.OBS_CATEGORY_DISPLAY)).alias("coding")))


def device_block(device_id: Column, device_type: Column, basic: bool = False) -> Column:
    """Device identifier + display (type, default 'Unknown Device'); the basic
    variant carries the identifier only."""
    display = (F.lit(None).cast("string") if basic
               else F.coalesce(device_type, F.lit(V.UNKNOWN_DEVICE_DISPLAY)))
    return F.struct(
        F.struct(F.lit(V.DEVICE_SYSTEM).alias("system"), device_id.alias("value"))
        .alias("identifier"), display.alias("display"))


def subject_block(patient_id: Column) -> Column:
    """Only for a non-empty patient id."""
    return F.when(F.length(patient_id) > 0, F.struct(
        F.concat(F.lit("Patient/"), patient_id).alias("reference"),
        F.struct(F.lit(V.PATIENT_SYSTEM).alias("system"), patient_id.alias("value"))
        .alias("identifier")))


def component(value: Column, code: str, display: str, text: str | None,
              unit: str, ucum: str) -> Column:
    return F.struct(
        F.struct(F.array(coding(V.LOINC_SYSTEM, code, display)).alias("coding"),
                 (F.lit(text) if text is not None else F.lit(None).cast("string"))
                 .alias("text")).alias("code"),
        F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"),
                 F.lit(V.UCUM_SYSTEM).alias("system"), F.lit(ucum).alias("code"))
        .alias("valueQuantity"))


def components(readings: Column, basic: bool = False) -> Column:
    """One component per key present in the readings MAP (null value kept),
    in the fixed order of the LOINC dictionary."""
    if basic:
        items = [component(readings[k], code, disp, None, unit, ucum)
                 for k, code, disp, unit, ucum in V.BASIC_COMPONENTS]
        keys = [b[0] for b in V.BASIC_COMPONENTS]
    else:
        items = [component(readings[k], code, disp, text, unit, ucum)
                 for k, _col, code, disp, text, unit, ucum in V.LOINC_COMPONENTS]
        keys = V.READING_KEYS
    empty = F.array().cast(_COMPONENT_ARRAY)
    return F.concat(*[F.when(F.map_contains_key(readings, k), F.array(c)).otherwise(empty)
                      for k, c in zip(keys, items)])


_COMPONENT_ARRAY = ("array<struct<code:struct<coding:array<struct<system:string,code:string,"
                    "display:string>>,text:string>,valueQuantity:struct<value:double,"
                    "unit:string,system:string,code:string>>>")


def interpretation(alerts: Column) -> Column:
    return F.when(F.size(alerts) > 0, F.array(F.struct(
        F.array(coding(V.INTERPRETATION_SYSTEM, V.INTERPRETATION_CODE,
                       V.INTERPRETATION_DISPLAY)).alias("coding"),
        F.array_join(alerts, ", ").alias("text"))))


def event_date(timestamp: Column) -> Column:
    """Calendar date of the message's own timestamp (wall date as written); null
    when the timestamp is missing or malformed."""
    valid = F.try_to_timestamp(timestamp).isNotNull()
    return F.when(valid & timestamp.rlike(r"^\d{4}-\d{2}-\d{2}"),
                  F.try_to_date(F.substring(timestamp, 1, 10)))


def storage_date(timestamp: Column) -> Column:
    """Date in the object key: the event date, else the processing date."""
    return F.coalesce(event_date(timestamp), F.current_date())


def partition_key(device_type: Column) -> Column:
    return F.lower(F.replace(F.coalesce(device_type, F.lit("unknown")), F.lit(" "),
                             F.lit("_")))


def object_key(type_key: Column, date: Column, obs_id: Column, prefix: str = "observations") -> Column:
    return F.concat(F.lit(prefix + "/"), type_key, F.lit("/"),
                    F.date_format(date, "yyyy/MM/dd"), F.lit("/"), obs_id, F.lit(".json"))


def first_code(component_col: Column) -> Column:
    """First coding's code of a component (null-safe)."""
    return F.get(component_col["code"]["coding"], 0)["code"]
