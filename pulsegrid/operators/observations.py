"""Device message <-> FHIR Observation.

``build_observations`` turns enriched messages into Observation rows (the
document's top-level fields as columns, so Parquet prunes nested fields) plus
storage columns: partition key, event date, object key and the metadata the
store attaches (device / patient / observation id).

``observations_wide`` is the inverse: one wide row per Observation with the
seven vitals as columns. All components of an Observation live in one row,
so the default extracts them row-locally with higher-order functions -- no
explode, no shuffle. ``mode="grouped"`` keeps the explode + group-by pivot
for inputs where one Observation id may be split over several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fhir as H
from ..functions.vocab import LOINC_COMPONENTS

OBSERVATION_FIELDS = ["resourceType", "id", "meta", "identifier", "status", "category",
                      "effectiveDateTime", "issued", "device", "subject", "component",
                      "interpretation"]
WIDE_KEYS = ["observation_id", "status", "effective_timestamp", "patient_reference",
             "device_id"]


# of an enriched message, what an Observation is built from
SOURCE_FIELDS = ["deviceId", "deviceType", "patientId", "timestamp", "messageId", "readings", "alerts"]
STORAGE_KEYS = ["device_type", "observation_date", "id"]


def _readings() -> Column:
    return F.coalesce(F.col("readings"), F.create_map().cast("map<string,double>"))


def _observation_id(enriched: DataFrame) -> Column:
    message_id = F.col("messageId") if "messageId" in enriched.columns else F.lit(None)
    return H.observation_id(F.col("deviceId"), F.col("timestamp"), message_id, _readings())


def keyed_messages(enriched: DataFrame, keep: tuple = ()) -> DataFrame:
    """What ``build_observations`` needs of each message, with the keys of its document.

    A document is many times as large as its message: what shuffles or sorts does so on
    these rows, and the documents are built from them afterwards."""
    return enriched.select(
        *keep, *[c for c in SOURCE_FIELDS if c in enriched.columns],
        H.partition_key(F.col("deviceType")).alias("device_type"),
        H.event_date(F.col("timestamp")).alias("observation_date"),
        _observation_id(enriched).alias("id"))


def build_observations(enriched: DataFrame, basic: bool = False,
                       keep: tuple = ()) -> DataFrame:
    """Enriched message -> Observation row + storage columns.

    ``basic`` builds the inline variant: heart rate and SpO2 only, no subject,
    no interpretation, stored under the processing date without a type level.
    """
    ts = F.col("timestamp")
    readings = _readings()
    keyed = not basic and set(STORAGE_KEYS) <= set(enriched.columns)  # by ``keyed_messages``
    alerts = (F.coalesce(F.col("alerts"), F.array().cast("array<string>"))
              if "alerts" in enriched.columns else F.array().cast("array<string>"))
    obs_id = F.col("id") if keyed else _observation_id(enriched)
    no_struct = F.lit(None)
    cols = {
        "resourceType": F.lit("Observation"),
        "id": obs_id,
        "meta": no_struct.cast("struct<versionId:string,lastUpdated:string,"
                               "profile:array<string>>") if basic else H.meta(),
        "identifier": (F.lit(None).cast("array<struct<system:string,value:string>>")
                       if basic else H.identifier(obs_id)),
        "status": F.lit("final"),
        "category": H.category(),
        "effectiveDateTime": ts,
        "issued": F.lit(None).cast("string") if basic else H.now_iso_z(),
        "device": H.device_block(F.col("deviceId"), F.col("deviceType"), basic=basic),
        "subject": (F.lit(None).cast("struct<reference:string,identifier:"
                                     "struct<system:string,value:string>>")
                    if basic else H.subject_block(F.col("patientId"))),
        "component": H.components(readings, basic=basic),
        "interpretation": (F.lit(None).cast(
            "array<struct<coding:array<struct<system:string,code:string,display:string>>,"
            "text:string>>") if basic else H.interpretation(alerts)),
    }
    out = enriched.select(*keep, *[c.alias(n) for n, c in cols.items()],
                          F.col("deviceType").alias("_device_type"),
                          *(STORAGE_KEYS[:2] if keyed else ()),
                          F.col("deviceId").alias("_device_id"),
                          F.col("patientId").alias("_patient_id"))
    if basic:
        date = F.current_date()
        storage = {
            "device_type": F.lit(None).cast("string"),
            "observation_date": date,
            "object_key": F.concat(F.lit("observations/"), F.date_format(date, "yyyy/MM/dd"),
                                   F.lit("/"), F.col("id"), F.lit(".json")),
        }
    else:
        tkey = H.partition_key(F.col("_device_type"))
        # the pruning column is exact: rows without an event date stand in the
        # null partition, whatever date their key carries
        storage = {} if keyed else {
            "device_type": tkey,
            "observation_date": H.event_date(F.col("effectiveDateTime")),
        }
        storage |= {
            "object_key": H.object_key(tkey, H.storage_date(F.col("effectiveDateTime")), F.col("id")),
        }
    storage.update({
        "meta_device_id": F.coalesce(F.col("_device_id"), F.lit("unknown")),
        "meta_patient_id": F.coalesce(F.col("_patient_id"), F.lit("unknown")),
        "meta_observation_id": F.col("id"),
        "source": F.lit("device"),
    })
    return out.withColumns(storage).drop("_device_type", "_device_id", "_patient_id")


def observation_json(obs: DataFrame) -> DataFrame:
    """Serialize each Observation to its JSON document."""
    present = [c for c in OBSERVATION_FIELDS if c in obs.columns]
    return obs.select("id", "object_key", F.to_json(F.struct(*present)).alias("document"))


def observation_heads(obs: DataFrame) -> DataFrame:
    """Flat header fields read from Observation documents."""
    return obs.select(
        F.col("id").alias("observation_id"),
        "status",
        F.try_to_timestamp(F.col("effectiveDateTime")).alias("effective_timestamp"),
        F.col("subject.reference").alias("patient_reference"),
        F.col("device.identifier.value").alias("device_id"),
        "component")


def observation_components(obs: DataFrame) -> DataFrame:
    """One row per component (Observations without any keep one null row)."""
    h = observation_heads(obs)
    return (h.select(*WIDE_KEYS, F.posexplode_outer("component").alias("pos", "c"))
            .select(*WIDE_KEYS, "pos",
                    H.first_code(F.col("c")).alias("loinc_code"),
                    F.col("c.valueQuantity.value").alias("value"),
                    F.col("c.valueQuantity.unit").alias("unit")))


def _code_is(code: str):
    def pred(c):
        return H.first_code(c) == F.lit(code)
    return pred


def observations_wide(obs: DataFrame, mode: str = "rowwise") -> DataFrame:
    """One row per Observation: 5 keys + 7 vitals (first component per code)."""
    if mode == "grouped":
        comps = observation_components(obs)
        aggs = [F.min_by(F.col("value"),
                         F.when(F.col("loinc_code") == F.lit(code), F.col("pos"))).alias(col)
                for _k, col, code, *_ in LOINC_COMPONENTS]
        return comps.groupBy(*WIDE_KEYS).agg(*aggs)
    h = observation_heads(obs)
    vitals = []
    for _k, col, code, *_ in LOINC_COMPONENTS:
        hit = F.filter(F.col("component"), _code_is(code))
        vitals.append(F.get(hit, 0)["valueQuantity"]["value"].alias(col))
    return h.select(*WIDE_KEYS, *vitals)
