"""Secret scanning with an incremental blob ledger (DataFrame functions only).

Every historical version of a text is addressed by its content (SHA-256); the
ledger is a Parquet table with one row per scanned blob and the findings of
every rule version applied to it.  A run scans only blob and rule-version pairs
that the ledger lacks, each distinct blob once, appends them in one atomic
write, and joins the findings back to every path that holds the blob.  The text
of repeated blobs is reduced before the shuffle; the join back carries digests
only, and AQE splits it where one blob sits under a large share of the paths.

Spans: matches are leftmost and non-overlapping per rule.  ``split`` gives the
text between the matches and ``regexp_extract_all`` the matches; the running sum
of both lengths gives code-point positions (end exclusive).

Defined results: null text is the empty text (no findings); repeated rows each
get their findings; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import free_name, id_text


@dataclass(frozen=True)
class Rule:
    """One rule version: ``pattern`` finds candidates, ``least`` characters of
    capture group ``group`` make one a finding."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# FIXED VALUES: kinds in report order.  The first three are the base rules.  A
# maximal run of 16+ hex digits is what the unbounded run with a length test
# finds; the same holds for AKIA runs of 18+ characters.  The assignment keeps
# the length test apart, because a short value still consumes its text.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<s:bigint,e:bigint>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (s, e) of one rule's findings."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), value.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.lit(None).cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["hit"]), F.lit(0))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= rule.least)
        one = F.array(F.struct(s.alias("s"), e.alias("e")))
        out = F.when(keep, F.when(acc["out"].isNull(), one).otherwise(F.concat(acc["out"], one))
                     ).otherwise(acc["out"])
        return F.struct(e.cast("long").alias("at"), out.cast(SPANS).alias("out"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["out"])
    # most texts hold no match at all: one pass over them is enough
    return F.when(F.regexp_like(text, pattern), spans).cast(SPANS)


def _results(text: Column, pending: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(F.array(*[
        F.when(F.array_contains(pending, r.name),
               F.struct(F.lit(r.name).alias("rule"),
                        rule_spans(text, r).alias("spans"))) for r in rules]),
        lambda x: x.isNotNull())


def read_ledger(spark, ledger: str) -> DataFrame | None:
    """blob, results over all runs so far; None before the first run."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return (spark.read.parquet(ledger).groupBy("blob")
            .agg(F.array_distinct(F.flatten(F.collect_list("results"))).alias("results")))


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions (path, text) -> path, findings: array<kind, s, e> by start, then rule order.

    ``ledger`` is a folder all executors share; it is created on the first run.
    """
    spark = versions.sparkSession
    named = versions.select("path", "text", F.sha2(F.col("text"), 256).alias("blob"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    known = read_ledger(spark, ledger)
    unseen = named.select("blob", "text")
    if known is None:
        unseen = unseen.withColumn("pending", wanted)
    else:
        done = known.select("blob", F.transform("results", lambda x: x["rule"]).alias("done"))
        unseen = (unseen.join(done, "blob", "left")
                  .select("blob", "text", F.array_except(
                      wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("pending"))
                  .where(F.size("pending") > 0))
    (unseen.groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))
     .select("blob", _results(F.col("text"), F.col("pending"), rules).alias("results"))
     .write.mode("append").parquet(ledger))

    order = F.create_map(*[x for i, r in enumerate(rules)
                           for x in (F.lit(r.name), F.struct(F.lit(i).alias("k"),
                                                             F.lit(r.kind).alias("kind")))])
    flat = F.flatten(F.transform("results", lambda x: F.transform(
        F.coalesce(x["spans"], F.array().cast(SPANS)),
        lambda y: F.struct(y["s"].alias("s"), order[x["rule"]]["k"].alias("k"),
                           y["e"].alias("e"), order[x["rule"]]["kind"].alias("kind")))))
    findings = (read_ledger(spark, ledger)
                .withColumn("results", F.filter("results", lambda x: F.array_contains(wanted, x["rule"])))
                .select("blob", F.array_sort(flat).alias("findings"))
                .where(F.size("findings") > 0))
    return (named.select("path", "blob").join(findings, "blob", "left")
            .select("path", F.coalesce("findings", F.array().cast(
                "array<struct<s:bigint,k:int,e:bigint,kind:string>>")).alias("findings")))


def secret_report(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and span lists per document, through the ledger."""
    ledger = ledger or scratch_path(docs.sparkSession, "blob-ledger")
    versions = id_text(docs, id_col, text_col).withColumnRenamed("doc_id", "path")
    scanned = scan_versions(versions, ledger, rules)
    label = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        F.col("path").alias("doc_id"), *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", label), ",").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by ``mark``; overlapping spans get one mark.

    Each row carries its own content address, so rows that share an id are
    matched by what they hold, not by the id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, hits = free_name(docs, "_blob"), free_name(docs, "_findings")
    blobs = docs.select(F.sha2(text, 256).alias("path"), text.alias("text"))
    found = (scan_versions(blobs, scratch_path(spark, "blob-ledger"))
             .where(F.size("findings") > 0)
             .groupBy("path").agg(F.first("findings").alias(hits))
             .withColumnRenamed("path", key))
    joined = docs.withColumn(key, F.sha2(text, 256)).join(found, key, "left")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        lead = F.substring(F.col(text_col), (acc["at"] + 1).cast("int"),
                           F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        fresh = (x["s"] >= acc["at"])
        return F.struct(
            F.when(fresh, F.concat(acc["out"], lead, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["e"]).alias("at"))

    clean = F.aggregate(hits, state, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"),
                                F.lit(2147483647))))
    return (joined.withColumn(text_col, F.when(F.col(hits).isNotNull(), clean)
                              .otherwise(F.col(text_col)))
            .drop(key, hits))


def _sql_spans(rule: Rule, k: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, s, s + length(hit) AS e FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits[i] AS hit, vals[i] AS val,
           list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS hits,
                 regexp_extract_all(t, '{p}', {rule.group}) AS vals,
                 string_split_regex(t, '{p}') AS gaps
          FROM docs WHERE regexp_matches(t, '{p}')))
  WHERE length(val) >= {rule.least}"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
per_doc AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b,
         count(*) FILTER (k = 2) AS c,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS every
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs d LEFT JOIN per_doc p USING (doc_id)
"""
