"""Observation and Patient search / read / create as table operators.

* search: conjunction of the non-empty filters, then the first ``count``
  matches in storage-key order (the order a store listing returns). Filters
  are plain column predicates, so Parquet pushes them into the scan; the
  top-k is a per-partition TakeOrderedAndProject, never a full sort.
* read by id: a batch of requested ids left-joined to the table, first
  match per id in key order; unmatched ids get an outcome row.
* create: force the resource type, fill a missing id, append.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _and(preds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, preds) if preds else None


def _day(bound: str) -> date | None:
    try:
        return date.fromisoformat(bound[:10]) if len(bound) >= 10 else None
    except ValueError:
        return None


def search_predicate(patient: str | None = None, device: str | None = None,
                     date_from: str | None = None, date_to: str | None = None,
                     strict: bool = False, prune: bool = False) -> Column | None:
    """Predicate over Observation rows; an empty value means 'no filter'.

    patient: substring of subject.reference (strict: equals 'Patient/<id>');
    missing subject never matches. device: exact identifier value.
    date_from / date_to: inclusive string comparison on effectiveDateTime,
    a missing value compares as '' (dropped by a lower bound, kept by an
    upper one). ``prune`` adds observation_date bounds for partition pruning;
    rows without an event date are in the null partition and always looked at,
    so the result is the same. A bound that starts with no date does not prune.
    """
    # Written so that Parquet can evaluate each predicate from row-group
    # statistics. For a non-empty value v, coalesce(x, '') >= v is x >= v
    # (null never passes), coalesce(x, '') <= v is (x IS NULL OR x <= v), and
    # a substring test of coalesce(x, '') is the substring test of x.
    preds = []
    ref = F.col("subject.reference")
    if patient:
        preds.append(ref == F.lit(f"Patient/{patient}") if strict
                     else ref.contains(F.lit(patient)))
    if device:
        preds.append(F.col("device.identifier.value") == F.lit(device))
    eff = F.col("effectiveDateTime")
    if date_from:
        preds.append(eff >= F.lit(date_from))
        if prune and (day := _day(date_from)):
            preds.append(F.col("observation_date").isNull() | (F.col("observation_date") >= F.lit(day)))
    if date_to:
        preds.append(eff.isNull() | (eff <= F.lit(date_to)))
        if prune and (day := _day(date_to)):
            preds.append(F.col("observation_date").isNull() | (F.col("observation_date") <= F.lit(day)))
    return _and(preds)


def search_observations(obs: DataFrame, patient: str | None = None,
                        device: str | None = None, date_from: str | None = None,
                        date_to: str | None = None, count: int | str = 100,
                        strict: bool = False, prune: bool = False) -> DataFrame:
    """First ``count`` matching Observations in storage-key order."""
    n = int(count)
    pred = search_predicate(patient, device, date_from, date_to, strict, prune)
    hits = obs.where(pred) if pred is not None else obs
    if n <= 0:
        return hits.limit(0)
    return hits.orderBy(F.col("object_key").asc_nulls_last(), F.col("id").asc_nulls_last()).limit(n)


MAX_PAGE = 1000


def bundle(resources: DataFrame, bundle_type: str = "searchset") -> DataFrame:
    """One-row Bundle of a search page: total = number returned, entries with
    fullUrl 'urn:uuid:<id>' and the resource, in key order. A page is at most
    ``MAX_PAGE`` resources; more is an error, not a shorter bundle."""
    from .observations import OBSERVATION_FIELDS
    present = [c for c in OBSERVATION_FIELDS if c in resources.columns] or resources.columns
    entries = resources.limit(MAX_PAGE + 1).select(F.struct(
        F.col("object_key").alias("k"),
        F.concat(F.lit("urn:uuid:"), F.coalesce(F.col("id"), F.expr("uuid()"))).alias("fullUrl"),
        F.to_json(F.struct(*present)).alias("resource")).alias("_e"))
    agg = entries.agg(F.count(F.lit(1)).alias("total"),
                      F.sort_array(F.collect_list("_e")).alias("_entries"))
    now = F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return agg.select(
        F.lit("Bundle").alias("resourceType"),
        F.expr("uuid()").alias("id"),
        F.struct(now.alias("lastUpdated")).alias("meta"),
        F.lit(bundle_type).alias("type"),
        F.when(F.col("total") <= MAX_PAGE, F.col("total")).otherwise(F.raise_error(
            F.lit(f"a bundle holds at most {MAX_PAGE} resources"))).cast("bigint").alias("total"),
        F.transform("_entries", lambda e: F.struct(e["fullUrl"].alias("fullUrl"),
                                                   e["resource"].alias("resource")))
        .alias("entry"))


def read_by_id(table: DataFrame, requests: DataFrame, resource_type: str,
               id_col: str = "requested_id", order_col: str | None = "object_key") -> DataFrame:
    """Left join of requested ids to ``table`` (first match per id).

    Returns requests columns + found + the table's columns + an outcome
    (severity 'error', code 'not-found', diagnostics '<Type>/<id> not found').
    The table is first reduced to the requested ids with a semi join, so the
    de-duplicating aggregate only sees matching rows.
    """
    from pyspark.sql import Window
    ids = requests.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    matched = table.join(ids, "id", "left_semi")
    other = [c for c in matched.columns if c != "id"]
    # first match per id (in storage-key order when the table has one); a
    # row_number() == 1 filter is planned as a group limit applied before the
    # shuffle as well as after it, so copies of one id never pile up in a task
    order = (F.col(order_col).asc_nulls_last() if order_col and order_col in matched.columns
             else F.col("id"))
    w = Window.partitionBy("id").orderBy(order)
    matched = (matched.withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") == 1).drop("_rn"))
    first = matched.select(F.col("id").alias("_id"), F.struct(*other).alias("_r"))
    joined = requests.join(first, requests[id_col] == first["_id"], "left")
    found = F.col("_id").isNotNull()
    return joined.select(
        *requests.columns, found.alias("found"), F.col("_id").alias("id"), "_r.*",
        F.when(~found, F.lit("error")).alias("outcome_severity"),
        F.when(~found, F.lit("not-found")).alias("outcome_code"),
        F.when(~found, F.concat(F.lit(f"{resource_type}/"), F.col(id_col),
                                F.lit(" not found"))).alias("outcome_diagnostics"))


def observation_index(spark, store: str, root: str):
    """Index of an Observation store: ranges of key, device and date per file, id -> file."""
    from ..sinks.storeindex import StoreIndex
    return StoreIndex(spark, store, root, {
        "object_key": F.col("object_key"), "device": F.col("device.identifier.value"),
        "effective": F.col("effectiveDateTime")}, id_col="id", key="object_key")


def search_page(index, patient: str | None = None, device: str | None = None, date_from: str | None = None,
                date_to: str | None = None, count: int | str = 100, strict: bool = False) -> tuple[DataFrame, int]:
    """``search_observations`` through the store's index: the same page, read file by file in
    key order until it is full; with it the number of files read."""
    pred = search_predicate(patient, device, date_from, date_to, strict, prune=True)
    files = index.may_hold(equal={"device": device} if device else {}, least={"effective": date_from} if date_from else {},
                           most={"effective": date_to} if date_to else {}, null_passes=("effective",) if not date_from else ())
    if int(count) <= 0:
        rows, _ = index.page(1, F.lit(False), F.lit(False))
        return rows, 0
    return index.page(int(count), pred, files)


def read_located(index, requests: DataFrame, resource_type: str, id_col: str = "requested_id") -> tuple[DataFrame, int]:
    """``read_by_id`` that opens only the files that hold a requested id; with it their number."""
    paths = index.holding(requests, id_col)
    if not paths:
        some, _ = index.page(1, F.lit(False), F.lit(False))
        return read_by_id(some, requests, resource_type, id_col), 0
    return read_by_id(index.read(paths), requests, resource_type, id_col), len(paths)


def create_resources(resources: DataFrame, resource_type: str,
                     fill_id: bool = True) -> DataFrame:
    """Force resourceType; fill a missing id with a random UUID."""
    out = resources.withColumn("resourceType", F.lit(resource_type))
    if fill_id:
        idc = F.col("id") if "id" in resources.columns else F.lit(None).cast("string")
        out = out.withColumn("id", F.coalesce(idc, F.expr("uuid()")))
    return out


def api_storage_columns(created: DataFrame) -> DataFrame:
    """Storage key for API-created Observations: observations/api/<today>/<id>.json;
    the pruning column is the event date, as for device documents."""
    from ..functions.fhir import event_date
    today = F.current_date()
    return created.withColumns({
        "device_type": F.lit("api"),
        "observation_date": event_date(F.col("effectiveDateTime")),
        "object_key": F.concat(F.lit("observations/api/"), F.date_format(today, "yyyy/MM/dd"),
                               F.lit("/"), F.col("id"), F.lit(".json")),
        "source": F.lit("api"),
    })


def parse_search_params(params: str | dict | None) -> dict:
    """'k=v&k2=v2' (or a dict) -> {k: v}; empty -> {}."""
    if not params:
        return {}
    if isinstance(params, dict):
        return {k: v for k, v in params.items() if v not in (None, "")}
    out = {}
    for part in params.split("&"):
        if "=" in part:
            k, v = part.split("=", 1)
            if v != "":
                out[k] = v
    return out


def search_patients(patients: DataFrame, params: str | dict | None) -> DataFrame:
    """Conjunction of equality predicates on patient columns.

    The value is cast to the column's type (not the column to text), so the
    predicate stays pushable into the scan; a value that does not parse as
    that type matches nothing."""
    types = dict(patients.dtypes)
    preds = []
    for k, v in parse_search_params(params).items():
        if k not in types:
            raise ValueError(f"unknown search parameter: {k}")
        preds.append(F.col(k) == F.lit(str(v)).try_cast(types[k]))
    p = _and(preds)
    return patients.where(p) if p is not None else patients


def search_resources(tables: dict, resource_type: str, params: str | dict | None = None) -> DataFrame:
    """Search with the table chosen by resource type: Observations by the date,
    patient, device and count parameters, other types by column equality."""
    if resource_type not in tables:
        raise ValueError(f"Resource type {resource_type} not supported")
    p = parse_search_params(params)
    if resource_type != "Observation":
        return search_patients(tables[resource_type], p)
    known = {"patient": "patient", "device": "device", "date_from": "date_from",
             "date_to": "date_to", "_count": "count"}
    unknown = set(p) - set(known)
    if unknown:
        raise ValueError(f"unknown search parameter: {sorted(unknown)[0]}")
    return search_observations(tables[resource_type], **{known[k]: v for k, v in p.items()})


def create_by_type(resources: DataFrame, resource_type: str, supported=("Observation", "Patient")) -> DataFrame:
    """Create with the storage layout of the type; every resource gets an id."""
    if resource_type not in supported:
        raise ValueError(f"Resource type {resource_type} not supported")
    created = create_resources(resources, resource_type)
    return api_storage_columns(created) if resource_type == "Observation" else created


def read_resources(tables: dict, resource_type: str, requests: DataFrame,
                   id_col: str = "requested_id") -> DataFrame:
    """Read-by-id with the table chosen by resource type ({'Patient': df, ...}).
    An unsupported type yields one outcome row per request."""
    table = tables.get(resource_type)
    if table is None:
        return requests.select(
            "*", F.lit(False).alias("found"), F.lit("error").alias("outcome_severity"),
            F.lit("not-supported").alias("outcome_code"),
            F.lit(f"Resource type {resource_type} not supported").alias("outcome_diagnostics"))
    order = "object_key" if "object_key" in table.columns else None
    return read_by_id(table, requests, resource_type, id_col=id_col, order_col=order)
