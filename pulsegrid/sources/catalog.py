"""Catalog registration of written tables and ad-hoc SQL over them.

Registration is what a Spark user writes: an external table over the
Parquet location, then partition discovery. The saved-result form writes a
query's result set to a location, like a query service's result bucket.

``refresh`` keeps a table over a growing area current: it infers the schema of files that
came since the last refresh, merges it into the registered one, records what changed,
and discovers new partitions. Run it on a schedule, for the raw and the FHIR area.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path
from ..sinks.runlog import RunLog


def create_database(spark: SparkSession, name: str | None = None,
                    location: str | None = None) -> str:
    name = name or f"pulsegrid_{uuid.uuid4().hex[:8]}"
    location = location or scratch_path(spark, f"db_{name}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{location}'")
    return name


def register_table(spark: SparkSession, database: str, table: str, path: str,
                   partitioned: bool = False) -> str:
    """External Parquet table over ``path``; discover partitions if any."""
    full = f"`{database}`.`{table}`"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {full} USING parquet LOCATION '{path}'")
    if partitioned:
        spark.catalog.recoverPartitions(f"{database}.{table}")
    return f"{database}.{table}"


def register_etl_tables(spark: SparkSession, database: str, etl_result) -> dict:
    """Register every table an ETL run wrote (partitioned ones discovered)."""
    from ..plans.etl import TABLE_PATHS
    partitioned = {"device_readings", "hourly_trends"}
    out = {}
    for t in TABLE_PATHS:
        if etl_result.rows.get(t):
            out[t] = register_table(spark, database, t, etl_result.path(t), t in partitioned)
    return out


def run_sql(spark: SparkSession, text: str, result_location: str | None = None) -> DataFrame:
    """Run SQL over registered tables; optionally save the result set."""
    df = spark.sql(text)
    return saved(df, result_location) if result_location else df


def saved(df: DataFrame, location: str) -> DataFrame:
    df.write.mode("overwrite").parquet(location)
    return df.sparkSession.read.parquet(location)


def register_landing(spark: SparkSession, database: str, table: str, path: str,
                     schema=None) -> str:
    """The raw JSON landing area as a catalog table with an explicit schema
    (not inferred), read recursively so nested arrival folders are included."""
    from ..schemas import RAW_MESSAGE
    full = f"{database}.{table}"
    if not spark.catalog.tableExists(full):
        spark.catalog.createTable(full, path=path, source="json",
                                  schema=schema or RAW_MESSAGE,
                                  recursiveFileLookup="true", mode="PERMISSIVE")
    return full


# --------------------------------------------------------------------- refresh
_NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]
DRIFT = ("table_name string, column_name string, change string, from_type string, to_type string, "
         "run int, found_at timestamp")


def merge_types(old: T.DataType, new: T.DataType, path: str, changes: list[tuple]) -> T.DataType:
    """The type that holds both; ``changes`` gets (column, change, from, to).

    Structs and arrays merge inside. Numbers widen to the larger one, different scalars
    to text. A scalar against a struct or array is a conflict: the registered type
    stays, and the other values read as text or null."""
    a, b = old.simpleString(), new.simpleString()
    if a == b:
        return old
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return merge_schemas(old, new, changes, f"{path}.")
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(merge_types(old.elementType, new.elementType, f"{path}[]", changes))
    if a in _NUMBERS and b in _NUMBERS:
        at = max(_NUMBERS.index(a), _NUMBERS.index(b))
        if {a, b} & {"float", "double"} and {a, b} & {"int", "bigint"}:
            at = _NUMBERS.index("double")
        wide = _NUMBERS[at]
        if wide != a:
            changes.append((path, "widened", a, wide))
        return old if wide == a else T._parse_datatype_string(wide)
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(old, nested) or isinstance(new, nested):
        changes.append((path, "conflict", a, b))
        return old
    if a != "string":
        changes.append((path, "widened", a, "string"))
    return T.StringType()


def merge_schemas(old: T.StructType, new: T.StructType, changes: list[tuple], prefix: str = "") -> T.StructType:
    """Fields of both, the registered order first."""
    known = {f.name: f for f in old.fields}
    found = {f.name: f for f in new.fields}
    out = []
    for f in old.fields:
        kind = merge_types(f.dataType, found[f.name].dataType, prefix + f.name, changes) if f.name in found else f.dataType
        out.append(T.StructField(f.name, kind))
    for f in new.fields:
        if f.name not in known:
            changes.append((prefix + f.name, "added", None, f.dataType.simpleString()))
            out.append(T.StructField(f.name, f.dataType))
    return T.StructType(out)


def _register(spark: SparkSession, full: str, path: str, schema: T.StructType, fmt: str, partitions: list[str]) -> None:
    """(Re)create the external table; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {full}")
    data = [f for f in schema.fields if f.name not in partitions]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in partitions)
    options = "" if partitions else "OPTIONS (recursiveFileLookup 'true')"
    by = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE {full} ({cols}{', ' + keys if keys else ''}) USING {fmt} {options} {by} LOCATION '{path}'")


def refresh(spark: SparkSession, database: str, table: str, path: str, log_root: str, fmt: str = "json",
            partitions: list[str] | tuple = (), at: datetime | None = None) -> list[tuple]:
    """Bring the catalog table over ``path`` up to date; returns the changes it found.

    Only files that no refresh read before are looked at. The first refresh registers
    the table and is no drift. A refresh that stopped is repeated under its number."""
    full = f"{database}.{table}"
    log = RunLog(spark, f"{log_root.rstrip('/')}/{table}")
    run = log.open_run()
    number = run.number if run else log.begin("catalog")
    last = log.last_commit()
    old = T.StructType.fromJson(json.loads(last["schema"])) if last.get("schema") else None
    names = log.take(number, "area", path)
    changes: list[tuple] = []
    schema = old
    if names:
        reader = spark.read.option("basePath", path) if partitions else spark.read
        found = (reader.option("dropFieldIfAllNull", "true").json(names) if fmt == "json"
                 else reader.option("mergeSchema", "true").format(fmt).load(names)).schema
        schema = found if old is None else merge_schemas(old, found, changes)
    if schema is not None and (schema != old or not spark.catalog.tableExists(full)):
        _register(spark, full, path, schema, fmt, list(partitions))
    if partitions and schema is not None:
        spark.catalog.recoverPartitions(full)
    if schema is not None:
        spark.catalog.refreshTable(full)  # files that came since are listed
    at = at or datetime.now(timezone.utc)
    rows = [(table, *c, int(number), at) for c in changes]
    spark.createDataFrame(rows, DRIFT).write.mode("overwrite").parquet(f"{log.root}/drift/run={number}")
    log.mark(number, "commit", schema=schema.json() if schema is not None else None, files=len(names))
    return changes


def drift(spark: SparkSession, log_root: str, table: str) -> DataFrame:
    """Every change that refreshes of the table recorded."""
    log = RunLog(spark, f"{log_root.rstrip('/')}/{table}")
    done = [f"{log.root}/drift/run={r.number}" for r in log.runs() if r.state == "commit"]
    return spark.read.schema(DRIFT).parquet(*done) if done else spark.createDataFrame([], DRIFT)
