"""The batch ETL job: landing areas -> silver tables -> gold aggregates.

Silver tables are written first and the gold aggregates come from partial states
of the written rows: that cuts the lineage at a durable table (a lost executor
re-reads Parquet instead of re-parsing JSON) and avoids caching a silver frame
that at scale would not fit in memory. Each write reports its row count through an
``Observation`` metric, not a second job.

A run is one commit over silver and gold (``sinks/runlog.py``). A full run
replaces the tables. An incremental run adds the rows of messages that the tables do not
hold yet, in steps that can each be repeated: ``stage`` the new rows, ``publish``
them, store their partial ``states``, bring ``gold`` up to date for the keys they
touch, ``commit``. If a run stops, the next one finishes it from its staged rows
(or drops it, if it had staged none) before it starts its own. Gold never reads
earlier silver rows: it merges the states of all runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fhir import observation_id
from ..operators import enrich, gold
from ..operators import observations as O
from ..schemas import ROLLUPS
from ..session import scratch_path
from ..sinks.runlog import RunLog
from ..sinks.tables import quarantine_rows, table_exists, write_table
from ..sources import files

DEVICE_READINGS_COLUMNS = [
    "device_id", "device_type", "patient_id", "ts", "heart_rate", "blood_oxygen",
    "systolic_bp", "diastolic_bp", "temperature", "blood_glucose", "respiratory_rate",
    "alert_count", "alert_types", "alert_severity", "has_critical_alert", "date", "hour",
    "channel"]


@dataclass
class EtlResult:
    """Rows written per table (0: nothing to write, the table is as it was) and
    rejected records per table."""
    output: str
    rows: dict = field(default_factory=dict)
    rejects: dict = field(default_factory=dict)

    def path(self, table: str) -> str:
        return f"{self.output}/{TABLE_PATHS[table]}"

    def reject_path(self, table: str) -> str:
        return f"{self.output}/quarantine/{table}"


TABLE_PATHS = {
    "device_readings": "processed/device_readings",
    "fhir_observations": "processed/fhir_observations",
    "patient_summary": "analytics/patient_summary",
    "device_analytics": "analytics/device_analytics",
    "hourly_trends": "analytics/hourly_trends",
}
# silver table -> its key, its partition columns, and the gold tables that come from it
SILVER = {
    "device_readings": ("reading_id", ("date", "device_type"), ("device_analytics", "hourly_trends")),
    "fhir_observations": ("observation_id", (), ("patient_summary",)),
}
GOLD_PARTITIONS = {"hourly_trends": ("date",)}
MAX_STATES = 16  # stored states of a table before a run merges them into one


def silver_readings(messages: DataFrame, keep: tuple = ()) -> DataFrame:
    """Readable messages -> flat enriched readings, each with the id of its message
    (the same for a message that is read again)."""
    msgs = files.valid_rows(messages)
    mid = F.col("messageId") if "messageId" in msgs.columns else F.lit(None)
    msgs = msgs.withColumn("reading_id", observation_id(
        F.col("deviceId"), F.col("timestamp"), mid, F.col("readings")))
    return enrich.flatten_messages(msgs).select(*keep, "reading_id", *DEVICE_READINGS_COLUMNS)


def _day(table: str) -> F.Column:
    """The event day of a silver row, by which known keys are looked up."""
    return F.col("date") if table == "device_readings" else F.to_date("effective_timestamp")


def _null_safe(left: DataFrame, right: DataFrame, cols) -> F.Column:
    same = F.lit(True)
    for c in cols:
        same = same & left[c].eqNullSafe(right[c])
    return same


class IncrementalRun:
    """One increment over the tables below ``output``, step by step.

    ``stage`` needs the input; every later step needs only what earlier ones
    wrote, and repeating a step changes nothing.
    """

    STEPS = ("publish", "states", "gold", "commit")

    def __init__(self, spark: SparkSession, output: str, log: RunLog, number: str, sketch: bool = False):
        self.spark, self.log, self.number, self.sketch = spark, log, number, sketch
        self.res = EtlResult(output)
        self.facts = log.facts(number, "staged") if _marked(log, number, "staged") else None
        self.again = self.facts is not None  # picked up from an earlier, stopped run
        self.base = log.last_commit()

    # ------------------------------------------------------------------ places
    def _staged(self, table: str) -> str:
        return f"{self.log.folder(self.number)}/staged/{table}"

    def _state(self, table: str, name: str) -> str:
        return f"{self.res.output}/_states/{table}/{name}"

    def _keys(self, table: str, number: str | None = None) -> str:
        return f"{self.res.output}/_keys/{table}" + (f"/run={number}" if number else "")

    def _staged_rows(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._staged(table))

    # ------------------------------------------------------------------- steps
    def stage(self, silver: dict[str, DataFrame], wanted: set[str],
              rejects: dict[str, DataFrame] | None = None) -> None:
        """The new rows of each silver table, each message once, into the run's folder."""
        kept, refused = {}, {}
        for table, bad in (rejects or {}).items():
            refused[table] = write_table(bad, f"{self.res.reject_path(table)}/run={self.number}", skip_if_empty=True)
        for table, rows in silver.items():
            key = SILVER[table][0]
            # copies inside the increment: the same one whatever the order they come in;
            # a row without a key is no copy of another
            content = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])
            w = Window.partitionBy(F.coalesce(key, content.cast("string"))).orderBy(content)
            rows = (rows.withColumn("_nth", F.row_number().over(w))
                    .where((F.col("_nth") == 1) | F.col(key).isNull()).drop("_nth"))
            if not table_exists(self.spark, self.res.path(table)):
                kept[table] = write_table(rows, self._staged(table))
                continue
            # the input is parsed once: days and new rows come from the stored copy
            arrived = f"{self.log.folder(self.number)}/arrived/{table}"
            write_table(rows, arrived)
            rows = self.spark.read.parquet(arrived)
            kept[table] = write_table(rows.join(self._known_keys(table, rows), key, "left_anti"), self._staged(table))
        self.facts = {"rows": kept, "rejects": refused, "wanted": sorted(wanted), "sketch": self.sketch}
        self.log.mark(self.number, "staged", **self.facts)

    def _known_keys(self, table: str, rows: DataFrame) -> DataFrame:
        """Keys the table holds on the days the increment touches: a list of days,
        so that whole partitions are left out before anything is read."""
        key, partitions, _ = SILVER[table]
        path = self.res.path(table)
        if partitions:
            store, day = self.spark.read.parquet(path), "date"
        else:
            if not table_exists(self.spark, self._keys(table)):
                self._write_keys(table, self.spark.read.parquet(path), "before")
            store, day = self.spark.read.parquet(self._keys(table)), "day"
        days = [r[0] for r in rows.select(_day(table)).distinct().collect()]
        dated = [d for d in days if d is not None]
        touched = F.col(day).isin(dated) if dated else F.lit(False)
        if None in days:
            touched = touched | F.col(day).isNull()
        return store.where(touched).select(key)  # of an anti join: copies do not matter

    def _write_keys(self, table: str, rows: DataFrame, number: str) -> None:
        write_table(rows.select(SILVER[table][0], _day(table).alias("day")), self._keys(table, number),
                    partition_cols=["day"])

    def publish(self) -> None:
        """Add the staged rows to the silver tables; a repeated try adds what is missing."""
        for table, n in self.facts["rows"].items():
            key, partitions, _ = SILVER[table]
            self._bootstrap(table)
            self.res.rows[table] = n
            if not n:
                continue
            rows = self._staged_rows(table)
            if self.again and table_exists(self.spark, self.res.path(table)):
                rows = rows.join(self.spark.read.parquet(self.res.path(table)).select(key), key, "left_anti")
            write_table(rows, self.res.path(table), mode="append", partition_cols=list(partitions), skip_if_empty=True)
            if not partitions:
                self._write_keys(table, self._staged_rows(table), self.number)
        self.res.rejects.update(self.facts["rejects"])

    def _gold_tables(self, table: str) -> list[str]:
        return [g for g in SILVER[table][2] if g in self.facts["wanted"]]

    def _bootstrap(self, table: str) -> None:
        """Tables without states in force (written before there was a log, or by runs
        that did not ask for this gold table): one state of what silver holds so far."""
        for g in self._gold_tables(table):
            name = f"{self.number}-before"
            if g not in self.base.get("states", {}) and table_exists(self.spark, self.res.path(table)) \
                    and not table_exists(self.spark, f"{self._state(g, name)}/_SUCCESS"):
                held = self.spark.read.parquet(self.res.path(table))
                if self.again:  # without what this run's first try may have added
                    key = SILVER[table][0]
                    held = held.join(self._staged_rows(table).select(key), key, "left_anti")
                write_table(gold.partial_state(held, ROLLUPS[g], self.facts["sketch"]), self._state(g, name))

    def states(self) -> None:
        """Partial states of the staged rows only."""
        for table, n in self.facts["rows"].items():
            for g in self._gold_tables(table) if n else ():
                write_table(gold.partial_state(self._staged_rows(table), ROLLUPS[g], self.facts["sketch"]),
                            self._state(g, self.number))

    def _names(self, g: str, n: int) -> list[str]:
        """States in force for a gold table once this run is done."""
        names = list(self.base.get("states", {}).get(g, []))
        before = f"{self.number}-before"
        if not names and table_exists(self.spark, self._state(g, before)):
            names = [before]
        return names + ([self.number] if n else [])

    def gold(self) -> None:
        """Gold rows of the keys that the staged rows touch, from the states of all runs."""
        for table, n in self.facts["rows"].items():
            for g in self._gold_tables(table) if n else ():
                names = self._names(g, n)
                if len(names) > MAX_STATES:
                    names = [self._compact(g, names)]
                state = self.spark.read.parquet(*[self._state(g, x) for x in names])
                self.res.rows[g] = self._bring_up_to_date(g, state)

    def _compact(self, g: str, names: list[str]) -> str:
        merged = f"{self.number}-merged"
        write_table(gold.combine_state(self.spark.read.parquet(*[self._state(g, x) for x in names]), ROLLUPS[g]),
                    self._state(g, merged))
        return merged

    def _bring_up_to_date(self, g: str, state: DataFrame) -> int:
        keys = list(ROLLUPS[g].keys)
        path, parts = self.res.path(g), list(GOLD_PARTITIONS.get(g, ()))
        touched = self.spark.read.parquet(self._state(g, self.number)).select(*(parts or keys)).distinct()
        # a stopped run may have left half a table, and one that was left out lacks keys
        whole = self.again or g not in self.base.get("states", {}) or not table_exists(self.spark, path)
        if not whole:
            state = state.join(touched, _null_safe(state, touched, parts or keys), "left_semi")
        new = gold.from_states(state, g)
        if whole:
            return write_table(new, path, partition_cols=parts)
        if parts:  # only the touched partitions are rewritten
            write_table(new, path, partition_cols=parts, dynamic_overwrite=True)
        else:
            old = self.spark.read.parquet(path)
            both = new.unionByName(old.join(touched, _null_safe(old, touched, keys), "left_anti"))
            staged = scratch_path(self.spark, f"etl-{g}")  # the write must not read what it replaces
            write_table(both, staged)
            write_table(self.spark.read.parquet(staged), path)
        return self.spark.read.parquet(path).count()

    def commit(self) -> None:
        states = dict(self.base.get("states", {}))
        for table, n in self.facts["rows"].items():
            for g in SILVER[table][2]:
                if not n:
                    continue
                states.pop(g, None)  # rows without a state: the next run that asks starts over
                if g in self.facts["wanted"]:
                    merged = f"{self.number}-merged"
                    names = self._names_before_merge(g)
                    states[g] = [merged] if len(names) > MAX_STATES else names
        self.log.mark(self.number, "commit", states=states, rows=self.res.rows, rejects=self.res.rejects)

    def _names_before_merge(self, g: str) -> list[str]:
        return self._names(g, 1)

    def finish(self, until: str | None = None) -> EtlResult:
        """All steps after ``stage`` (``until``: the last one to take, as if stopped there)."""
        for step in self.STEPS:
            getattr(self, step)()
            if step == until:
                break
        return self.res


def _marked(log: RunLog, number: str, state: str) -> bool:
    return any(r.number == number and state in r.marks for r in log.runs())


def resume(spark: SparkSession, output: str) -> EtlResult | None:
    """Finish the run that stopped, if there is one: from its staged rows, else drop it."""
    log = RunLog(spark, output)
    run = log.open_run()
    if run is None:
        return None
    if run.state == "begin":
        if log.facts(run.number, "begin")["kind"] == "full":
            raise RuntimeError("a full run stopped halfway: its tables have to be written again by a full run")
        log.mark(run.number, "dropped")
        return None
    return IncrementalRun(spark, output, log, run.number).finish()


def run_etl(spark: SparkSession, output: str, messages: DataFrame | None = None,
            observations: DataFrame | None = None, raw_path: str | list | None = None,
            fhir_path: str | list | None = None, keep: tuple = (),
            incremental: bool = False, tables: tuple | None = None,
            multiline: bool = False, missing_ok: bool = False, sketch: bool = False,
            until: str | None = None) -> EtlResult:
    """Write the tables below ``output`` (all five, or those named in ``tables``
    and the silver tables they come from).

    Inputs are either DataFrames (``messages``, ``observations``) or landing
    paths read with explicit schemas; ``multiline`` says that a file holds one
    observation document, else every line does. A missing path is an error
    unless ``missing_ok``. An input without rows changes no table.

    Unreadable records are kept in ``quarantine/<table>`` and counted.

    ``incremental``: of landing paths only files that no earlier run took are read;
    rows of messages that the silver tables do not hold yet are added, whatever
    their date, and a message that comes several times counts once. A run that
    stopped is finished first. ``until`` (a name of ``IncrementalRun.STEPS``, or
    ``stage``) stops after that step.

    ``sketch``: distinct counts from HyperLogLog sketches (``gold.sketch_error``)
    instead of exact ones; the same in all runs over one output.
    """
    log = RunLog(spark, output)
    wanted = set(tables or TABLE_PATHS)
    if incremental:
        resume(spark, output)
        number = log.begin("incremental", tables=sorted(wanted))
    new_files = (lambda area, p: log.take(number, area, p)) if incremental else (lambda area, p: p)
    if messages is None and raw_path is not None:
        messages = _read(files.read_device_messages, spark, raw_path, "raw", new_files, missing_ok)
    if observations is None and fhir_path is not None:
        observations = _read(lambda s, p, m: files.read_observations(s, p, multiline, m), spark, fhir_path, "fhir",
                             new_files, missing_ok)
    silver, rejects = {}, {}
    if messages is not None and wanted & {"device_readings", *SILVER["device_readings"][2]}:
        silver["device_readings"] = silver_readings(messages, keep)
        rejects["device_readings"] = messages
    if observations is not None and wanted & {"fhir_observations", *SILVER["fhir_observations"][2]}:
        silver["fhir_observations"] = O.observations_wide(files.valid_rows(observations))
        rejects["fhir_observations"] = observations
    rejects = {t: quarantine_rows(files.corrupt_rows(r), "unparseable") for t, r in rejects.items()
               if files.CORRUPT in r.columns}

    if incremental:
        run = IncrementalRun(spark, output, log, number, sketch)
        run.stage(silver, wanted, rejects)
        return run.res if until == "stage" else run.finish(until)
    return _full_run(spark, output, log, silver, wanted, rejects, sketch)


def _read(reader, spark, path, area, new_files, missing_ok):
    """The landing area as a frame; without (new) files it has no rows."""
    from pyspark.errors import AnalysisException
    try:
        path = new_files(area, path)
    except AnalysisException as e:
        if not (missing_ok and ("PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e))):
            raise
    if path == []:
        return None
    return reader(spark, path, missing_ok)


def _full_run(spark: SparkSession, output: str, log: RunLog, silver: dict, wanted: set,
              rejects: dict, sketch: bool) -> EtlResult:
    """Replace the tables; their states start afresh."""
    res = EtlResult(output)
    number = log.begin("full", tables=sorted(wanted))
    states = dict(log.last_commit().get("states", {}))
    for table, bad in rejects.items():
        res.rejects[table] = write_table(bad, res.reject_path(table), skip_if_empty=True)
    for table, rows in silver.items():
        res.rows[table] = write_table(rows, res.path(table), partition_cols=list(SILVER[table][1]), skip_if_empty=True)
        if not res.rows[table]:
            continue
        if not SILVER[table][1]:
            keys = spark.read.parquet(res.path(table)).select(
                SILVER[table][0], F.lit(number).alias("run"), _day(table).alias("day"))
            write_table(keys, f"{output}/_keys/{table}", partition_cols=["run", "day"])
        for g in SILVER[table][2]:
            states.pop(g, None)
            if g in wanted:
                place = f"{output}/_states/{g}/{number}"
                write_table(gold.partial_state(spark.read.parquet(res.path(table)), ROLLUPS[g], sketch), place)
                res.rows[g] = write_table(gold.from_states(spark.read.parquet(place), g), res.path(g),
                                          partition_cols=list(GOLD_PARTITIONS.get(g, ())))
                states[g] = [number]
    log.mark(number, "commit", states=states, rows=res.rows, rejects=res.rejects)
    return res


def read_back_counts(spark: SparkSession, res: EtlResult) -> DataFrame:
    """(table, rows) for every written table, counted from the files."""
    frames = [spark.read.parquet(res.path(t)).agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(t).alias("table_name"), "rows")
              for t in TABLE_PATHS if res.rows.get(t)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def main(argv=None) -> int:
    """spark-submit entry: python -m pulsegrid.plans.etl --raw R --fhir F --out O"""
    import argparse
    import json

    from ..session import build_session
    ap = argparse.ArgumentParser(description="device readings / observations ETL")
    ap.add_argument("--raw", nargs="*", default=None, help="raw message landing path(s)")
    ap.add_argument("--fhir", nargs="*", default=None, help="Observation document path(s)")
    ap.add_argument("--out", required=True, help="output root")
    ap.add_argument("--incremental", action="store_true")
    ap.add_argument("--multiline", action="store_true", help="one observation document per file")
    ap.add_argument("--missing-ok", action="store_true", help="a missing landing path is no error")
    ap.add_argument("--sketch", action="store_true", help="distinct counts from sketches")
    a = ap.parse_args(argv)
    spark = build_session(app="pulsegrid-etl")
    res = run_etl(spark, a.out, raw_path=a.raw, fhir_path=a.fhir, incremental=a.incremental,
                  multiline=a.multiline, missing_ok=a.missing_ok, sketch=a.sketch)
    print(json.dumps({"output": res.output, "rows": res.rows, "rejects": res.rejects}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
