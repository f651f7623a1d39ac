"""Merkle dataset manifest with proofs by pointer jumping.

Every document is a leaf: the SHA-256 of its fields.  The leaves of a group
(``lang``) in id order form a tree of runs of ``arity`` nodes, and the groups'
subroots in group order form the tree above them, whose top is the root of the
whole table.  Changing, adding or removing one row changes the root; a row is
proved against the root by its own leaf and the siblings on its path.

Proofs come from pointer jumping.  Every node holds the segment of siblings
towards an ancestor, at first its parent.  A self-join of the nodes on that
ancestor doubles the distance and concatenates the two segments; after k rounds
a pointer reaches 2**k levels up, so log2(height) rounds bring every leaf to its
root.  Of the inner nodes a round keeps only the levels that later rounds point
at, so all of them together stay below the number of leaves.

Work and memory: positions come from a range sort and the counts of its
partitions; digests are computed in blocks of 1,024 neighbours, at most ten levels
at a time; a joined ancestor stands for at most 1,024 leaves per key, since one
far up is spread over the blocks below it.  So neither a group with a third
of all rows nor a root is one task.  What every round needs again is a written table.

Defined results: a null field is written ``-``; null groups are one group, the
first; null ids come first in their group; rows that share an id are ordered by
their leaf, and equal rows are leaves each; an empty table has no root and no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

ARITY = 2
BLOCK_LEVELS = 10  # levels of a binary tree that one block holds
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    """H: SHA-256 over the parts as text, in hexadecimal digits."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field_text(c: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value as text."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return digest_of(*[field_text(c) for c in fields])


def _text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def _parent(parts: Column) -> Column:
    return F.unhex(F.sha2(_text(_joined(parts)).cast("binary"), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The digest at the end of a proof, for a raw leaf digest."""
    return F.aggregate(path, leaf, lambda acc, s: F.unhex(F.sha2(
        _text(F.concat(s["before"], acc, s["after"])).cast("binary"), 256)))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a proof, left to right, lowest level first."""
    return digest_of(F.aggregate(path, F.lit(""), lambda acc, s: F.concat(
        acc, _text(s["before"]), _text(s["after"]))))


def positions(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows (written) with ``pos`` in their group and the group's ``size``.

    A range sort by group and order; a row's place is its place in the partition
    plus what earlier partitions hold of the group. Rows that tie in all of
    ``order`` must be interchangeable.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = rows.columns
    # the last key only deals equal rows out over several partitions
    ranged = (rows.repartitionByRange(parts, group, *order, F.rand(11))
              .sortWithinPartitions(group, *order)
              .withColumn("at", F.monotonically_increasing_id()))
    ranged = durable(ranged.select("*", F.shiftright("at", 33).alias("part")), f"{name}-sorted")
    counts = ranged.groupBy("part", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    upto = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", group, "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"),
                            F.sum("n").over(w).alias("size"))
    return ranged.join(offsets, ["part", group]).select(
        *cols, (F.col("at") - F.col("first") + F.col("base")).alias("pos"), "size")


def _height(size: Column, arity: int) -> Column:
    """Levels above the leaves: the least h with arity**h >= size."""
    out, k = [], 1
    while k < 2 ** 62:
        out.append((size > k).cast("int"))
        k *= arity
    return reduce(Column.__add__, out)


def _siblings(level: Column, i: Column, arity: int) -> list[Column]:
    """before, after: digests of the run's other members, for the 0-based place i."""
    first = i - i % arity
    return [_joined(F.slice(level, first + 1, i % arity)).alias("before"),
            _joined(F.slice(level, i + 2, F.lit(arity - 1) - i % arity)).alias("after")]


def _block_tier(rows: DataFrame, offset: int, levels: int, arity: int, name: str) -> DataFrame:
    """g, size, pos, digest, payload -> one written row per block of arity**levels
    neighbours: its members, and the digests of ``steps`` levels above them."""
    blocks = rows.groupBy("g", "size", F.expr(f"pos div {arity ** levels}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("members"))
    steps = F.least(F.lit(levels), _height(F.col("size"), arity) - offset)
    bottom = F.transform("members", lambda m: m["digest"])

    def above(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / arity).cast("int"))
        return F.concat(acc, F.array(F.transform(runs, lambda i: _parent(F.slice(last, i * arity + 1, F.lit(arity))))))

    one = F.array(*[F.lit(k) for k in range(1, levels + 1)])
    return durable(blocks.withColumn("steps", steps).withColumn(
        "levels", F.aggregate(F.slice(one, F.lit(1), F.col("steps")), F.array(bottom), above)), name)


def _inner_nodes(blocks: DataFrame, offset: int, levels: int, arity: int) -> DataFrame:
    """g, size, level, pos, path (the segment to the parent) of the nodes of a tier
    that are neither leaves of the whole tree nor tops of their block."""
    widths = F.array(*[F.lit(arity ** (levels - k)).cast("long") for k in range(levels + 1)])

    def of_level(a: Column, k: Column) -> Column:
        return F.transform(a, lambda x, i: F.struct(
            (k + offset).alias("level"), (F.col("block") * F.element_at(widths, k + 1) + i).alias("pos"),
            *_siblings(a, i, arity)))

    nodes = F.flatten(F.transform(F.slice("levels", F.lit(1), F.col("steps")), of_level))
    out = blocks.select("g", "size", F.explode(nodes).alias("x")).select(
        "g", "size", "x.level", "x.pos", F.array(F.struct("x.before", "x.after")).alias("path"))
    return out.where("level > 0") if offset == 0 else out


def _spread(nodes: DataFrame, distance: int, arity: int, span: int) -> DataFrame:
    """One copy of every node per block of leaves below it, as ``block``."""
    width = arity ** distance // span
    last = F.expr(f"(size - 1) div {span}")
    return nodes.withColumn("block", F.explode(F.sequence(
        F.col("up") * width, F.least((F.col("up") + 1) * width - 1, last))))


def paths(leaves: DataFrame, arity: int = ARITY, name: str = "merkle") -> tuple[DataFrame, DataFrame]:
    """Leaves (g, pos, size, digest, payload) of many trees -> each with ``path``, the
    siblings up to the top of its tree, and the tops (g, size, digest)."""
    levels = BLOCK_LEVELS
    while levels > 1 and arity ** levels > 2 ** BLOCK_LEVELS:
        levels -= 1
    span = arity ** levels
    tiers, tops, work, offset = [], [], leaves, 0
    while True:
        tiers.append(_block_tier(work, offset, levels, arity, f"{name}-blocks-{offset}"))
        top = tiers[-1].select("g", "size", F.col("block").alias("pos"), (F.col("steps") + offset).alias("level"),
                               F.element_at(F.element_at("levels", -1), 1).alias("digest"),
                               F.lit(None).cast("string").alias("payload"))
        done = F.col("level") == _height(F.col("size"), arity)
        tops.append(top.where(done).select("g", "size", "digest"))
        work = top.where(~done)
        offset += levels
        if work.isEmpty():
            break
    highest = leaves.agg(F.max(_height(F.col("size"), arity))).first()[0] or 0

    members = F.transform("members", lambda m: m["digest"])
    chain = tiers[0].select("g", "size", F.posexplode("members").alias("i", "m"), members.alias("all")).select(
        "g", "size", "m.pos", "m.digest", "m.payload",
        F.when(F.col("size") > 1, F.array(F.struct(*_siblings(F.col("all"), F.col("i"), arity))))
        .otherwise(F.expr("array()").cast("array<struct<before:binary,after:binary>>")).alias("path"))
    ups = reduce(DataFrame.unionByName, [_inner_nodes(b, i * levels, levels, arity) for i, b in enumerate(tiers)])
    distance = 1
    while distance < highest:
        ups = durable(ups, f"{name}-distance-{distance}")
        step = F.expr(f"pos div {arity ** distance}") if arity ** distance < 2 ** 62 else F.lit(0).cast("long")
        # leaves: from the ancestor at this distance on
        far = ups.where(F.col("level") == distance).select(
            "g", "size", F.col("pos").alias("up"), F.col("path").alias("more"))
        if arity ** distance > span:
            far = _spread(far, distance, arity, span).select("g", "block", "more")
            chain = chain.withColumn("block", F.expr(f"pos div {span}")).join(far, ["g", "block"], "left").drop("block")
        else:
            chain = chain.withColumn("up", step).join(far.drop("size"), ["g", "up"], "left").drop("up")
        longer = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))
        chain = chain.withColumn("path", longer).drop("more")
        # inner nodes that later rounds point at: the self-join doubles their distance
        mid = ups.where(F.col("level") % (2 * distance) == distance).select(
            "g", F.col("level").alias("mid"), F.col("pos").alias("up"), F.col("path").alias("more"))
        ups = (ups.where(F.col("level") % (2 * distance) == 0)
               .withColumns({"mid": F.col("level") + distance, "up": step})
               .join(mid, ["g", "mid", "up"], "left").withColumn("path", longer).drop("mid", "up", "more"))
        distance *= 2
    return chain, reduce(DataFrame.unionByName, tops)


def proofs(docs: DataFrame, leaf: Column, group: Column, order: Column, payload: dict[str, Column],
           arity: int = ARITY) -> DataFrame:
    """Every row of docs as a leaf with its proof: the payload columns, ``leaf``,
    ``subroot`` and ``root`` (raw digests) and ``path``, array of (before, after)."""
    # null group first, then by the bytes of the name
    g = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group.cast("string")))
    rows = docs.select(g.alias("g"), order.alias("by"), F.unhex(leaf).alias("digest"),
                       F.struct(*[c.alias(n) for n, c in payload.items()]).alias("payload"))
    leaves = durable(positions(rows, "g", ["by", "digest"], "merkle").drop("by"), "merkle-leaves")
    lower, subroots = paths(leaves, arity)
    # the tree above: one leaf per group
    heads = subroots.select(F.lit("").alias("top"), F.col("g").alias("tree"), "digest",
                            F.struct("g", F.col("size").alias("n")).alias("payload"))
    ranked = durable(positions(heads, "top", ["tree"], "merkle-top").select(
        F.col("top").alias("g"), "pos", "size", "digest", "payload"), "merkle-top-leaves")
    upper, root = paths(ranked, arity, "merkle-top")
    span = 2 ** BLOCK_LEVELS
    # a group's head stands once per block of its leaves
    head = upper.select("g", F.col("payload.g").alias("tree"), F.col("payload.n").alias("n"),
                       F.col("digest").alias("subroot"), F.col("path").alias("above"))
    head = head.join(root.select("g", F.col("digest").alias("root")), "g").select(
        F.col("tree").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {span}"))).alias("block"),
        "subroot", "root", "above")
    return lower.withColumn("block", F.expr(f"pos div {span}")).join(head, ["g", "block"]).select(
        "payload.*", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"))


def _fields(docs: DataFrame) -> dict[str, Column]:
    return {n: F.col(n).cast("long") if n in ("doc_id", "n_chars") else F.col(n).cast("string") for n in FIELDS}


def dataset_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path: what has to be kept to prove a row later."""
    f = _fields(docs)
    return proofs(docs, leaf_digest(list(f.values())), f["lang"], f["doc_id"],
                  {"doc_id": f["doc_id"], "lang": f["lang"]}, arity)


def verify(kept: DataFrame, leaf: str = "leaf") -> Column:
    """Whether a (possibly recomputed) raw leaf still leads to the kept root."""
    return fold(F.col(leaf), F.col("path")) == F.col("root")


def tamper_report(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Proofs of all rows, checked after every row whose id's crc32 is divisible by 7
    had its n_chars raised by one."""
    f = _fields(docs)
    hit = F.crc32(f["doc_id"].cast("string").cast("binary")) % 7 == 0
    changed = leaf_digest([f[n] + 1 if n == "n_chars" else f[n] for n in FIELDS])
    rows = proofs(docs, leaf_digest(list(f.values())), f["lang"], f["doc_id"],
                  {"doc_id": f["doc_id"], "changed": F.when(hit, F.unhex(changed))}, arity)
    rows = rows.withColumn("folded", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select(
        "doc_id", *[_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        proof_digest(F.col("path")).alias("proof_sha256"), _text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _sql_leaf(bump: str = "") -> str:
    return "sha256(" + " || ".join(_sql_field(f"({c}{bump if c == 'n_chars' else ''})") for c in FIELDS) + ")"


def _sql_levels(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, digest, size FROM {source}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2
  FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 2, size)"""


_SQL_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT)), lambda crc, x: list_reduce([xor(crc, x), 1, 1, 1, 1, 1, 1, 1, 1],
    lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))"""

SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '-') AS tree, {_sql_leaf()} AS leaf,
    CASE WHEN xor({_SQL_CRC}, 4294967295::BIGINT) % 7 = 0 THEN {_sql_leaf(' + 1')} ELSE {_sql_leaf()} END AS given
  FROM documents),
ranked AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS size
  FROM docs),
{_sql_levels('lower_tree', 'ranked')},
heads AS (
  SELECT '' AS tree, tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size
  FROM lower_tree WHERE size = 1),
{_sql_levels('upper_tree', 'heads')},
path AS (
  SELECT r.row, n.level AS step, (r.pos >> n.level) % 2 = 1 AS is_right, coalesce(s.digest, '') AS sibling
  FROM ranked r JOIN lower_tree n ON n.tree = r.tree AND n.pos = r.pos >> n.level AND n.size > 1
  LEFT JOIN lower_tree s ON s.tree = n.tree AND s.level = n.level AND s.pos = xor(n.pos, 1)
  UNION ALL
  SELECT r.row, 100 + n.level, (h.pos >> n.level) % 2 = 1, coalesce(s.digest, '')
  FROM ranked r JOIN heads h ON h.lang = r.tree JOIN upper_tree n ON n.pos = h.pos >> n.level AND n.size > 1
  LEFT JOIN upper_tree s ON s.level = n.level AND s.pos = xor(n.pos, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY step) AS k FROM path),
folds AS (
  SELECT row, 0 AS k, given AS digest FROM ranked
  UNION ALL
  SELECT f.row, f.k + 1, sha256(CASE WHEN s.is_right THEN s.sibling || f.digest ELSE f.digest || s.sibling END)
  FROM folds f JOIN steps s ON s.row = f.row AND s.k = f.k + 1),
ends AS (SELECT row, max_by(digest, k) AS folded_root FROM folds GROUP BY row),
digests AS (SELECT row, string_agg(sibling, '' ORDER BY k) AS siblings FROM steps GROUP BY row)
SELECT r.doc_id, r.leaf, h.digest AS subroot, t.digest AS root,
  sha256(coalesce(d.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM ranked r JOIN heads h ON h.lang = r.tree JOIN upper_tree t ON t.size = 1
JOIN ends e ON e.row = r.row LEFT JOIN digests d ON d.row = r.row
"""
