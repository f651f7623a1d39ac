"""Commit log of the batch job: what each run took, wrote and finished.

A run is a folder ``_runs/<number>`` below the output root. Small JSON marks say
how far it came -- ``begin``, ``staged``, ``commit`` (or ``dropped``) -- and a
Parquet table lists the files it took. Marks are created, never rewritten, so
one of two jobs that start the same run number fails instead of mixing with the other.

* ``begin`` only: nothing was published; the next run drops it and takes its files.
* ``staged``: the new rows lie in the run's folder; the next run finishes it from there.
* ``commit``: done; names the stored states in force from now on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_FIELDS = ("path", "length", "modified")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length, modified of every file below the paths (contents are not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
            .select("path", "length", F.col("modificationTime").alias("modified")))


@dataclass(frozen=True)
class Run:
    number: str
    marks: tuple[str, ...]

    @property
    def state(self) -> str:
        return next((s for s in ("commit", "dropped", "staged", "begin") if s in self.marks), "begin")


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/_runs"

    def folder(self, number: str) -> str:
        return f"{self.root}/{number}"

    def runs(self) -> list[Run]:
        """All runs in order, from one listing."""
        p, fs = _fs(self.spark, f"{self.root}/*/*.json")
        marks: dict[str, list[str]] = {}
        for s in fs.globStatus(p) or []:
            marks.setdefault(s.getPath().getParent().getName(), []).append(
                s.getPath().getName().removesuffix(".json"))
        return [Run(n, tuple(sorted(m))) for n, m in sorted(marks.items())]

    def mark(self, number: str, state: str, **facts) -> None:
        p, fs = _fs(self.spark, f"{self.folder(number)}/{state}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"run {number} is already marked {state}: another job writes here") from e
        try:
            out.write(bytearray(json.dumps(facts).encode()))
        finally:
            out.close()

    def facts(self, number: str, state: str) -> dict:
        p, fs = _fs(self.spark, f"{self.folder(number)}/{state}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def begin(self, kind: str, **facts) -> str:
        runs = self.runs()
        number = f"{int(runs[-1].number) + 1 if runs else 1:08d}"
        self.mark(number, "begin", kind=kind, **facts)
        return number

    def last_commit(self) -> dict:
        done = [r for r in self.runs() if r.state == "commit"]
        return self.facts(done[-1].number, "commit") if done else {}

    def open_run(self) -> Run | None:
        """The newest run, if it neither committed nor was dropped."""
        runs = self.runs()
        return runs[-1] if runs and runs[-1].state in ("begin", "staged") else None

    # ------------------------------------------------------------- files taken
    def take(self, number: str, area: str, paths: str | list[str]) -> list[str]:
        """Files of a landing area that no staged or committed run took, recorded as
        taken by this one. A file that was rewritten counts as new."""
        return self._take(number, area, list_files(self.spark, paths), FILE_FIELDS)

    def take_names(self, number: str, area: str, names: list[str]) -> list[str]:
        """The same for files named by a sink's own commit log, which never rewrites one."""
        listed = self.spark.createDataFrame([(n,) for n in names], "path string")
        return self._take(number, area, listed, ("path",))

    def _take(self, number: str, area: str, new: DataFrame, fields: tuple[str, ...]) -> list[str]:
        taken = f"{self.root}/taken/{area}"
        p, fs = _fs(self.spark, taken)
        if fs.exists(p):
            void = [int(r.number) for r in self.runs() if r.state in ("begin", "dropped")]
            before = self.spark.read.parquet(taken).where(~F.col("run").isin(void) if void else F.lit(True))
            new = new.join(before.select(*fields), list(fields), "left_anti")
        target = f"{taken}/run={number}"
        new.write.mode("overwrite").parquet(target)
        # names only; Spark's own file index holds the same list on the driver
        return [r.path for r in self.spark.read.parquet(target).select("path").collect()]
