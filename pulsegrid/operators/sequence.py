"""Next row of the same key in time order, without one task per key.

A plain ``lead`` over ``Window.partitionBy(key)`` puts every row of a key in
one task; a device holding a third of all readings would then be sorted by
a single task. Here the window runs per (key, time bucket), and only the
last row of each bucket is patched with the first row of the key's next
non-empty bucket, found over one row per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, key: str, order: list[str], fields: list[str],
              bucket: Column, out: str = "next") -> DataFrame:
    """Adds ``out`` = struct(fields) of the next row with the same ``key``
    ordered by ``order`` (null for the key's last row)."""
    payload = F.struct(*[F.col(c) for c in fields])
    b = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket").orderBy(*[F.col(c) for c in order])
    b = b.withColumns({out: F.lead(payload).over(w), "_rn": F.row_number().over(w)})
    # first row of each (key, bucket) straight from the same window (no
    # aggregate, no extra shuffle), then the next non-empty bucket's first
    firsts = b.where(F.col("_rn") == 1).select(key, "_bucket", payload.alias("_first"))
    w2 = Window.partitionBy(key).orderBy("_bucket")
    firsts = firsts.select(key, "_bucket", F.lead("_first").over(w2).alias("_next_first"))
    firsts = firsts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_from"), "_next_first")
    # null keys and null times are values like any other
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_from"))
    return (b.join(firsts, same, "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_next_first")))
            .drop("_bucket", "_next_first", "_rn", "_key", "_from"))
