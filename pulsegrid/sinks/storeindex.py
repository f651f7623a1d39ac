"""Index beside a Parquet store: what each file holds, and which file holds an id.

* ``files``: one row per data file with least and greatest value (and nulls) of a few
  columns. A search in key order reads files in that order until its page is full;
  a filter leaves out files whose range cannot match.
* ``ids``: 64-bit hash of the id -> file, in folders by hash bucket. A batch of ids reads
  only its buckets, and then only the files that hold them. A hash that two ids
  share costs a file too many, never a wrong row: the rows are compared by id.

``refresh`` looks at files that are new since the last one; files that are gone
leave the index. Runs are logged, and only committed ones are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runlog import RunLog
from .tables import write_table

ID_BUCKETS = 64
FIRST_FILES = 4   # files a page reads at first; four times as many in each further round


class StoreIndex:
    """``columns``: name -> column expression of the store to keep ranges of; ``id_col``:
    the column to locate rows by (None: no locator); ``key``: the name among
    ``columns`` that orders pages."""

    def __init__(self, spark: SparkSession, store: str, root: str, columns: dict[str, Column],
                 id_col: str | None = None, key: str | None = None, buckets: int = ID_BUCKETS):
        self.spark, self.store, self.root = spark, store.rstrip("/"), root.rstrip("/")
        self.columns, self.id_col, self.key, self.buckets = columns, id_col, key, buckets
        self.log = RunLog(spark, root)
        self._schema = None

    # ----------------------------------------------------------------- reading
    def _parts(self, name: str) -> list[str]:
        """Folders of the committed runs that wrote this part."""
        done = [(r.number, self.log.facts(r.number, "commit")) for r in self.log.runs() if r.state == "commit"]
        return [f"{self.root}/{name}/run={n}" for n, facts in done if facts.get(name)]

    def files(self) -> DataFrame | None:
        """file_no, path, uri, length, rows, <column>__min / __max / __nulls of every live file."""
        parts, gone = self._parts("files"), self._parts("gone")
        if not parts:
            return None
        out = self.spark.read.parquet(*parts)
        return out.join(self.spark.read.parquet(*gone), "file_no", "left_anti") if gone else out

    def read(self, paths: list[str]) -> DataFrame:
        """These files of the store, with its partition columns."""
        reader = self.spark.read.option("basePath", self.store)
        if self._schema is None:  # looked up once, not for every page
            self._schema = reader.parquet(*paths).schema
        return reader.schema(self._schema).parquet(*paths)

    # ----------------------------------------------------------------- writing
    def _on_disk(self) -> DataFrame:
        return (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet").load(self.store)
                .select("path", "length", F.col("_metadata.file_path").alias("uri")))

    def refresh(self) -> int:
        """Bring the index up to date; returns how many files were new."""
        run, self._schema = self.log.open_run(), None
        if run is not None:
            self.log.mark(run.number, "dropped")
        known = self.files()
        disk = self._on_disk()
        new, gone, base = disk, 0, 0
        number = self.log.begin("index")
        if known is not None:
            new = disk.join(known.select("uri", "length"), ["uri", "length"], "left_anti")
            lost = known.join(disk.select("uri", "length"), ["uri", "length"], "left_anti").select("file_no")
            gone = write_table(lost, f"{self.root}/gone/run={number}", skip_if_empty=True)
            base = (self.spark.read.parquet(*self._parts("files")).agg(F.max("file_no")).first()[0] or 0) + 1
        paths = [r.path for r in new.select("path").collect()]  # names; Spark's file index lists them too
        if not paths:
            self.log.mark(number, "commit", files=0, gone=gone, ids=0)
            return 0
        rows = self.read(paths).withColumn("uri", F.col("_metadata.file_path"))
        stats = rows.groupBy("uri").agg(
            F.count(F.lit(1)).alias("rows"),
            *[f(c).alias(f"{n}__{s}") for n, c in self.columns.items()
              for s, f in (("min", F.min), ("max", F.max), ("nulls", lambda x: F.count_if(x.isNull())))])
        listed = disk.join(stats, "uri").withColumn("file_no", F.monotonically_increasing_id() + F.lit(base))
        place = f"{self.root}/files/run={number}"
        n = write_table(listed, place)
        ids = self._write_ids(rows, place, number) if self.id_col else 0
        self.log.mark(number, "commit", files=n, gone=gone, ids=ids)
        return n

    def _write_ids(self, rows: DataFrame, files: str, number: str) -> int:
        no = self.spark.read.parquet(files).select("uri", "file_no")
        h = F.xxhash64(self.id_col)
        located = (rows.where(F.col(self.id_col).isNotNull()).select(h.alias("h"), "uri").join(no, "uri")
                   .select("h", "file_no", F.pmod("h", F.lit(self.buckets)).cast("int").alias("bucket")))
        return write_table(located, f"{self.root}/ids/run={number}", partition_cols=["bucket"], sort_cols=["h"])

    # ----------------------------------------------------------------- by id
    def holding(self, ids: DataFrame, id_col: str) -> list[str]:
        """Paths of the files that may hold any of the ids."""
        parts, files = self._parts("ids"), self.files()
        if not parts:
            return []
        asked = ids.select(F.xxhash64(id_col).alias("h")).where(F.col(id_col).isNotNull()).distinct()
        buckets = [r[0] for r in asked.select(F.pmod("h", F.lit(self.buckets)).cast("int")).distinct().collect()]
        locator = reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in parts])
        found = locator.where(F.col("bucket").isin(buckets)).join(asked, "h", "left_semi").select("file_no").distinct()
        return [r.path for r in files.join(found, "file_no", "left_semi").select("path").collect()]

    # ----------------------------------------------------------------- pages
    def may_hold(self, equal: dict | None = None, least: dict | None = None, most: dict | None = None,
                 null_passes: tuple = ()) -> Column:
        """Files that can hold a row with these column values or bounds; a column in
        ``null_passes`` also matches where it is null."""
        out = F.lit(True)
        tests = [(n, (F.col(f"{n}__min") <= F.lit(v)) & (F.col(f"{n}__max") >= F.lit(v))) for n, v in (equal or {}).items()]
        tests += [(n, F.col(f"{n}__max") >= F.lit(v)) for n, v in (least or {}).items()]
        tests += [(n, F.col(f"{n}__min") <= F.lit(v)) for n, v in (most or {}).items()]
        for n, test in tests:
            test = F.coalesce(test, F.lit(False))
            out = out & ((test | (F.col(f"{n}__nulls") > 0)) if n in null_passes else test)
        return out

    def page(self, count: int, where: Column | None = None, files_where: Column | None = None) -> tuple[DataFrame, int]:
        """The first ``count`` rows of ``where`` by (key, id), and how many files were read.

        Files come in order of their least key. A page is whole when ``count`` of its rows
        lie before the least key of every file not yet read.
        """
        files = self.files()
        where = F.lit(True) if where is None else where
        if files is None:
            raise ValueError("the index is empty: refresh it first")
        if files_where is not None:
            files = files.where(files_where)
        least = F.col(f"{self.key}__min")
        order = [least.asc_nulls_last(), F.col("file_no")]
        m = FIRST_FILES
        while True:
            first = files.orderBy(*order).select("path", least.alias("least")).limit(m + 1).collect()
            paths = [r.path for r in first[:m]]
            if not paths:
                some = self.files().limit(1).collect()[0].path
                return self.read([some]).where(F.lit(False)), 0
            hits = self.read(paths).where(where)
            key = self.columns[self.key]
            rest = first[m].least if len(first) > m else None
            if len(first) > m:
                sure = hits.where(key < F.lit(rest)) if rest is not None else hits.where(key.isNotNull())
                if sure.limit(count).count() < count:
                    m *= 4
                    continue
            rows = hits.orderBy(key.asc_nulls_last(), F.col(self.id_col).asc_nulls_last()) if self.id_col else \
                hits.orderBy(key.asc_nulls_last())
            return rows.limit(count), len(paths)
