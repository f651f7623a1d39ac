"""Exact duplicate removal by distributed MSD radix partitioning.

Documents are split by successive digits (byte ranges) of their normalised
text, most significant first.  A group stops being split when one document is
left in it or when its text has ended; documents of a group whose text has
ended are equal byte for byte, so no digest takes part in the decision.

Digits widen geometrically (``DIGITS``), so the number of rounds grows with the
logarithm of the longest text.  Each round is one pre-aggregated count per
(group, digit) -- a hot digit is reduced in every map task -- and one join that
AQE may split on a skewed digit; only documents that still share their whole
prefix with another one carry their remaining bytes to the next round.

Defined results: null text equals the empty text; of equal texts the row with
the largest id stays; null ids rank below all others; among identical rows
(same id and text) exactly one stays.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, durable, free_name, id_text

FIRST_DIGIT = 64
WIDEN = 16


def _normalise(batches):
    """ASCII lower case as bytes, with the digest that the report carries."""
    for b in batches:
        body = [t.encode().lower() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(body, pa.binary()),
             pa.array([hashlib.sha256(x).hexdigest() for x in body], pa.string())],
            names=["doc_id", "rest", "text_sha256"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 first_digit: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    arrow_conf(docs.sparkSession)
    work = (id_text(docs, id_col, text_col)
            .mapInArrow(_normalise, "doc_id long, rest binary, text_sha256 string")
            .withColumn("gid", F.lit(0).cast("long"))
            .withColumn("uid", F.monotonically_increasing_id()))
    done: list[DataFrame] = []
    width, depth = first_digit, 0
    while True:
        rows = work.select("doc_id", "uid", "text_sha256", "gid",
                           F.expr(f"substring(rest, 1, {width})").alias("digit"),
                           F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = (rows.groupBy("gid", "digit")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.max("doc_id").alias("top"))
                  .where("n > 1")
                  .withColumn("next", F.monotonically_increasing_id()))
        groups = durable(groups, f"radix-groups-{depth}")
        whole = f"length(digit) < {width}"  # the text has ended in this digit
        # never broadcast: the groups grow with the input, and the plan is to stay one
        # and the same at every size
        joined = rows.join(groups.hint("merge"), ["gid", "digit"], "left").select(
            "doc_id", "uid", "text_sha256",
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
            F.expr("CASE WHEN n > 1 THEN next END").alias("group"),
            F.expr(f"n > 1 AND NOT ({whole})").alias("open"),
            F.expr(f"CASE WHEN n > 1 AND NOT ({whole}) THEN rest END").alias("rest"))
        step = durable(joined.withColumn("open", F.coalesce("open", F.lit(False))),
                       f"radix-{depth}")
        done.append(step.where("NOT open").select(
            "doc_id", "uid", "text_sha256", "group_size", "keep_id", "group",
            F.lit(depth).alias("depth")))
        work = step.where("open").select("doc_id", "uid", "text_sha256", "rest",
                                         F.col("group").alias("gid"))
        if work.isEmpty():
            break
        # the first step is stored now, so its row numbers are stable from here on
        depth += 1
        width *= widen
    out = reduce(DataFrame.unionByName, done)
    # identical rows share the largest id: one of them stays
    top = out.where("group IS NOT NULL AND (doc_id <=> keep_id)")
    stay = top.groupBy("depth", "group").agg(F.max("uid").alias("stay"))
    tops = top.join(stay, ["depth", "group"]).withColumn("kept", F.expr("uid = stay"))
    rest = out.where("group IS NULL OR NOT (doc_id <=> keep_id)").withColumn(
        "kept", F.expr("group IS NULL"))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return rest.select(*cols).unionByName(tops.select(*cols))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Whole rows move once: the semi join and the choice among identical rows use
    the same keys (id and digest of the normalised text).
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key, digest = free_name(docs, "_id"), free_name(docs, "_sha")
    keyed = docs.withColumns({
        key: F.col(id_col).cast("long"),
        digest: F.sha2(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")),
                                   upper, lower), 256)})
    stay = (exact_groups(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias(key + "2"), F.col("text_sha256").alias(digest + "2")))
    return (keyed.join(stay, F.col(key).eqNullSafe(F.col(key + "2"))
                       & (F.col(digest) == F.col(digest + "2")), "left_semi")
            .dropDuplicates([key, digest]).drop(key, digest))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
