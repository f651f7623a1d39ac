"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document's set of word shingles gives ``TREES`` signatures of ``DEEPEST``
minimum hashes.  Each tree is one sorted order of signatures.  Documents whose
signatures share a prefix in some tree form a region; the prefix is ``SHALLOWEST``
hashes long.  Candidates come from regions in two ways:

* first, in regions cut deeper (up to ``DEEPEST`` hashes) where they hold more than
  ``REGION`` documents, neighbours in the sorted order (longest common prefix) and
  the pairs of each member with the region's smallest document: a few per document,
  enough to join most near copies;
* then the pairs of a whole region (``SHALLOWEST`` hashes, whatever its size) that
  lie in different components so far. They are decided where they meet: the sets of
  a region's members come together in blocks, an upper bound on the intersection
  (counts by hash bucket, exact as a bound) leaves most pairs out, the others are
  counted. A block keeps its own union-find and skips what is joined already, so
  links leave it, at most one less than it has components, and never pairs.

First pairs are confirmed on the full sets like the others. Equal sets are one node
from the start, so copies are never expanded into pairs.  Regions without a second
member, most of all, leave before any text is moved; sets are built for members
of other regions only.  Components come from minimum labels with pointer jumping;
links and labels stay distributed.

Chance of missing a link of similarity 0.85: (1 - 0.85**5)**16 < 0.0001 for one
pair, in regions of any size; nothing else is left out. (The small sketch only
chooses among first pairs.) Words and shingles are compared by 64-bit hashes.

Defined results: null, empty and blank texts have no shingles and stay alone; a
text of fewer than ``WORDS`` words is one shingle; rows that share an id and differ
in text are compared and kept each on its own, a component is named by its smallest
id; rows with a null id are not linked (component null, kept).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, durable, free_name, id_text
from .token_counts import batches_of
from .wordhash import mixed, word_hashes

WORDS = 5
PERCENT = 85
TREES, SHALLOWEST, DEEPEST = 16, 5, 8
REGION = 64
SKETCH = 64           # bytes of a node's sketch
SKETCH_AGREE = 42     # of these, for similarity 0.85: 54.7 expected, deviation 2.8
BLOCK = 2048          # members compared at once
BLOCK_SHINGLES = 4_000_000  # and shingles on a side of a block, on average
BUCKETS = 512         # counts per set in the bound on an intersection

_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_SHIFTS = _rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACES = (_rng.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ENTRY = np.dtype([("key", "<i8"), ("deeper", "<u2", (DEEPEST - SHALLOWEST,))])


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (ASCII lower case)."""
    out: list[np.ndarray] = []
    for lo, hi in batches_of(texts):
        h, cuts = word_hashes([t.encode().lower() for t in texts[lo:hi]])
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
            for i in range(words):
                rolled += h[i:i + len(rolled)] * _PLACES[i]
            rolled = mixed(rolled)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if z - a >= words:
                    out.append(np.unique(rolled[a:z - words + 1]))
                elif z > a:  # the whole sequence, told from longer ones by its length
                    whole = (h[a:z] * _PLACES[:z - a]).sum(dtype=np.uint64) + np.uint64(z - a)
                    out.append(mixed(np.array([whole], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * DEEPEST, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 4096):
            best = np.minimum(best, (low[None, i:i + 4096] * _FACTORS + _SHIFTS).min(axis=1))
    return best


def _print_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, print (of the set), forest (entry per tree), sketch."""
    def run(batches):
        for b in batches:
            rows = []
            for s in shingle_sets(b.column(1).to_pylist()):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = minimum_hashes(s).reshape(TREES, DEEPEST)
                entry = np.empty(TREES, _ENTRY)
                with np.errstate(over="ignore"):
                    head = (m[:, :SHALLOWEST].astype(np.uint64) * _PLACES[:SHALLOWEST]).sum(axis=1, dtype=np.uint64)
                    entry["key"] = mixed(head + np.arange(TREES, dtype=np.uint64) * _PLACES[9]).view(np.int64)
                entry["deeper"] = m[:, SHALLOWEST:] & 0xFFFF
                sketch = (m.ravel()[:: TREES * DEEPEST // SKETCH] & 0xFF).astype(np.uint8)
                rows.append((len(s), _print_of(s), entry.tobytes(), sketch.tobytes()))
            n, prints, forests, sketches = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(forests, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "n", "print", "forest", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n long, print binary, forest binary, sketch binary")


def tree_rows(nodes: DataFrame) -> DataFrame:
    """node, key (shallowest prefix with its tree), d1.. (deeper hashes): a row per tree."""
    deeper = [f"d{i + 1}" for i in range(DEEPEST - SHALLOWEST)]

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            e = np.frombuffer(b"".join(b.column(1).to_pylist()), _ENTRY)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, TREES)), pa.array(e["key"]),
                 *[pa.array(e["deeper"][:, i].astype(np.int32)) for i in range(len(deeper))]],
                names=["node", "key", *deeper])

    return nodes.select("node", "forest").mapInArrow(
        run, "node long, key long, " + ", ".join(f"{d} int" for d in deeper))


def region_members(nodes: DataFrame) -> DataFrame:
    """key, d1.., node, region: members of prefixes with two or more nodes. ``key`` is
    the whole region; ``region``, deeper where that is large, is for the first pairs
    only and may hold one node."""
    deeper = [f"d{i + 1}" for i in range(DEEPEST - SHALLOWEST)]
    levels = [["key", *deeper[:i]] for i in range(len(deeper) + 1)]
    rows = tree_rows(nodes)
    # sizes per prefix, deepest first: each is a sum over the one before
    counts = rows.groupBy(*levels[-1]).agg(F.count(F.lit(1)).alias("c"))
    shared = counts.groupBy("key").agg(F.sum("c").alias("size0")).where("size0 > 1")
    # prefixes of one document alone, most of all, are gone from here on
    sized = durable(counts.withColumnRenamed("c", f"size{len(deeper)}").join(shared.hint("merge"), "key"),
                    "forest-prefixes")
    for i in range(len(deeper) - 1, 0, -1):
        sums = sized.groupBy(*levels[i]).agg(F.sum(f"size{len(deeper)}").alias(f"size{i}"))
        sized = sized.join(sums, levels[i])
    depth = F.lit(len(deeper))
    for i in range(len(deeper) - 1, -1, -1):
        depth = F.when(F.col(f"size{i}") <= REGION, F.lit(i)).otherwise(depth)
    region = F.coalesce(*[F.when(F.col("depth") == i, F.xxhash64(F.lit(i), *levels[i]))
                          for i in range(len(deeper) + 1)])
    regions = sized.withColumn("depth", depth).withColumn("region", region).select(*levels[-1], "region")
    return durable(rows.join(regions.hint("merge"), levels[-1]), "forest-members")


def neighbour_pairs(members: DataFrame) -> DataFrame:
    """Pairs next to each other in a tree's sorted order, inside one region."""
    order = ["key", "d1", "d2", "d3", "node"]
    rows = members.repartitionByRange(*order).sortWithinPartitions(*order).select("region", "node")

    def run(batches):
        last = None
        for b in batches:
            region, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is not None:
                region, node = np.append(last[0], region), np.append(last[1], node)
            if len(node):
                last = region[-1], node[-1]
            at = np.flatnonzero(region[1:] == region[:-1])
            x, y = node[at], node[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))],
                                             names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def first_pairs(members: DataFrame) -> DataFrame:
    """Sorted neighbours, and every member with its region's smallest node."""
    lead = members.groupBy("region").agg(F.min("node").alias("a"))
    star = (members.select("region", F.col("node").alias("b")).join(lead.hint("merge"), "region")
            .where("a < b").select("a", "b"))
    return neighbour_pairs(members).unionByName(star).where("a < b").distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches agree."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"),
                                  F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH)
                    for i in (2, 3))
            keep = (x == y).sum(axis=1) >= SKETCH_AGREE
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]
                                             ).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |A & B| >= percent * |A | B| on full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}"))
    both = (pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
            .select("a", "b", "m_a", "m_b"))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]
                                             ).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def member_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, members (sorted 64-bit shingle hashes) of the nodes in some region."""
    wanted = (members.select("node").distinct()
              .join(nodes.select("node", "print", "first.doc_id", "first.text_hash"), "node"))
    texts = (docs.withColumn("text_hash", F.xxhash64("text"))
             .join(wanted.hint("merge"), ["doc_id", "text_hash"]).select("node", "print", "text"))

    def run(batches):
        for b in batches:
            out = [s if _print_of(s) == p else None for s, p in
                   zip(shingle_sets(b.column(2).to_pylist()), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if s is None else s.tobytes() for s in out], pa.binary())],
                names=["node", "members"])

    # rows that repeat an id and a text: once
    return durable(texts.mapInArrow(run, "node long, members binary").where("members IS NOT NULL")
                   .dropDuplicates(["node"]), "forest-sets")


def _local_roots(batches):
    """Union-find over one partition's pairs: each node with its smallest local one."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = sorted((root(x), root(y)))
            parent[y] = x
    pairs = [(root(x), x) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)],
                                     names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component (smallest node reachable), linked nodes only."""
    edges = durable(links.mapInArrow(_local_roots, "a long, b long"), "cc-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = durable(both.groupBy(F.col("a").alias("node"))
                     .agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        hop = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels2 = durable(hop.join(jump.hint("merge"), "component").select(
            "node", "old", F.least("component", "further").alias("component")), "cc-labels")
        labels = labels2.select("node", "component")
        if labels2.where("component < old").isEmpty():
            return labels


def decided(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], mine: np.ndarray, others: np.ndarray,
            percent: int) -> list[tuple[int, int]]:
    """Links between members of different components: every pair of ``mine`` and ``others``
    is decided on full sets, unless links of the block have joined its components before."""
    n = np.array([len(x) for x in sets], np.int64)
    counts = np.zeros((len(sets), BUCKETS), np.uint32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for i, x in enumerate(sets):
        counts[i] = np.bincount((x >> shift).astype(np.int64), minlength=BUCKETS)
    _, own = np.unique(comp, return_inverse=True)
    root = np.arange(own.max() + 1 if len(own) else 0)  # of each component of the block
    links = []
    for k in mine.tolist():
        at = others[(root[own[others]] != root[own[k]])]
        at = at[100 * np.minimum(n[at], n[k]) >= percent * np.maximum(n[at], n[k])]
        if not len(at):
            continue
        most = np.minimum(counts[at], counts[k]).sum(axis=1, dtype=np.int64)
        ok = 100 * most >= percent * (n[at] + n[k] - most)
        at = at[ok][np.argsort(-most[ok], kind="stable")]
        while len(at):
            step = max(int(np.searchsorted(np.cumsum(n[at]), 200_000)), 1)
            now, at = at[:step], at[step:]
            flat = np.concatenate([sets[i] for i in now])
            place = np.minimum(np.searchsorted(sets[k], flat), n[k] - 1)
            common = np.add.reduceat((sets[k][place] == flat).astype(np.int64), np.cumsum(n[now]) - n[now])
            for i in now[100 * common >= percent * (n[now] + n[k] - common)].tolist():
                x, y = root[own[k]], root[own[i]]
                if x != y:
                    links.append((int(min(node[k], node[i])), int(max(node[k], node[i]))))
                    root[root == max(x, y)] = min(x, y)
            at = at[root[own[at]] != root[own[k]]]
    return links


def region_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame,
                 percent: int) -> DataFrame:
    """a, b: links between different components inside whole regions, enough to join
    all that their members' pairs join."""
    placed = (members.select(F.col("key").alias("region"), "node").join(labels.hint("merge"), "node", "left")
              .withColumn("component", F.coalesce("component", "node"))
              .join(nodes.select("node", "n").hint("merge"), "node"))
    mixed_up = (placed.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                             F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"))
                .where("lo < hi"))
    # the largest component of a region is compared with the others only, not with itself
    sizes = (placed.join(mixed_up.select("region", "size", "volume").hint("merge"), "region")
             .groupBy("region", "component").agg(F.count(F.lit(1)).alias("own"), F.max("size").alias("size"),
                                                 F.sum("n").alias("mine"), F.max("volume").alias("volume")))
    most = F.struct("own", "component")
    main = sizes.groupBy("region").agg(F.max_by("component", most).alias("main"), F.max("size").alias("size"),
                                       F.max("own").alias("own"), F.max("volume").alias("volume"),
                                       F.max_by("mine", most).alias("mine"))
    blocks = lambda members, shingles: F.expr(
        f"CAST(greatest(ceil(({members}) / {BLOCK}), ceil(({shingles}) / {BLOCK_SHINGLES})) AS INT)")
    rows = (placed.join(main.hint("merge"), "region")
            .withColumn("rest", F.col("component") != F.col("main"))
            .withColumn("rows", blocks("size - own", "volume - mine"))
            .withColumn("cols", blocks("size", "volume")))
    # block (i, j) of a region: rest members of row block i against all members of column
    # block j; where there is one block every member goes there once, as both
    salt = F.xxhash64("node")
    one = F.expr("rows = 1 AND cols = 1")
    left = (rows.where(F.col("rest") & ~one).withColumn("i", F.pmod(salt, F.col("rows")).cast("int"))
            .withColumn("j", F.explode(F.expr("sequence(0, cols - 1)"))).withColumn("side", F.lit(0)))
    right = (rows.withColumn("j", F.pmod(salt, F.col("cols")).cast("int"))
             .withColumn("i", F.explode(F.expr("sequence(0, rows - 1)")))
             .withColumn("side", F.when(one & F.col("rest"), F.lit(2)).otherwise(F.lit(1))))
    cells = left.unionByName(right).select("region", "i", "j", "side", "node", "component")
    cells = cells.join(sets.hint("merge"), "node").select("region", "i", "j", "side", "node", "component", "members")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        found = decided(t.column("node").to_numpy(), t.column("component").to_numpy(),
                        [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()],
                        np.flatnonzero(side != 1), np.flatnonzero(side != 0), percent)
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def _judged(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: one row per input row."""
    spark = docs.sparkSession
    arrow_conf(spark)
    docs = id_text(docs, id_col, text_col)
    signed = durable(signatures(docs), "forest-signatures")
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets are one node, numbered when stored; its first row has the smallest id
    nodes = durable(named.groupBy("print").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n").alias("n"),
        F.first("forest").alias("forest"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "forest-nodes")
    members = region_members(nodes)
    sets = member_sets(docs, nodes, members)

    near = durable(_likely(first_pairs(members), nodes, percent), "forest-pairs")
    links = durable(confirm(near, sets, percent), "forest-links")
    labels = components(links)
    more = durable(region_links(members, labels, nodes, sets, percent), "forest-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    # a component is named by its smallest id
    placed = nodes.select("node", "print", F.col("first.doc_id").alias("id")).join(
        labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    owner = placed.join(placed.groupBy("component").agg(F.min("id").alias("name")).hint("merge"),
                        "component").select("print", "name")
    return (signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "print")
            .join(owner.hint("merge"), "print", "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(
                F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    return _judged(docs, percent, id_col, text_col).drop("text_hash")


def drop_near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document, the smallest id, of every component."""
    name, text = free_name(docs, "_gone"), free_name(docs, "_gone_text")
    gone = (_judged(docs, percent).where("NOT kept")
            .select(F.col("doc_id").alias(name), F.col("text_hash").alias(text)).distinct())
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col(name))
                     & (own == F.col(text)), "left_anti")
