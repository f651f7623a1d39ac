"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Rows and bytes of one Arrow batch: bounds a Python worker's working set.
ARROW_ROWS = 512
ARROW_BYTES = 8 * 1024 * 1024


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver got it from.

    The zip goes to executors through Spark's own file distribution, once per
    application; nothing reads the driver's copy later.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pulsegrid_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="pulsegrid-")) / "pulsegrid_src.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._pulsegrid_shipped = True


def arrow_conf(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Batch bounds and importable code for the Python stages that follow."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            keep: Iterable[str] = ()) -> DataFrame:
    """Only the columns an operator reads; null text becomes the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in keep])


def crc_bucket(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (the fixed hold-out rule)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use (names differ beyond case)."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base += "_"
    return base
