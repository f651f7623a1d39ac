"""Hard-negative mining over an inverted multi-index with certified windows.

Vectors become integers (floor of ``scale`` times each component) and are cut in
two halves.  Each half has its own codebook; a row lies in the cell of its two
codewords.  For an anchor, a half's score with any row of a codeword is at most
the score with the codeword plus the anchor's norm times the codeword's radius,
so two sorted lists of half bounds bound every cell.  A multi-sequence heap
visits the cells by falling sum of the two bounds.

A search asks for windows: the first ``k`` rows, best score first and ties by
smaller id, with a score from ``lo`` to ``hi``.  A window is certified as soon as
the next cell's bound is below its lower end or below its k-th score; an anchor
stops when all its windows are.  Nothing is estimated: results equal a full scan.

First every anchor's positives are searched (one open window among rows of its
label), then for each positive the window between two percentages of its score
among rows of other labels; all windows of an anchor share one traversal.

Cells are gathered in shards of bounded size; a cell that is larger (one vector may be
a third of all rows) is dealt out over several.  An anchor goes first to the shard
with its best bound, then, with the k-th scores found there as lower ends, only to
shards with a cell that can still hold something.  Anchors come in chunks, and a
task holds one shard and one chunk.  With vectors that have no clusters in their halves
hardly any cell can be left out, and the work is that of comparing every anchor with
every row.

The codebooks are fitted on about ``SAMPLE`` rows chosen by a hash of the id; radii,
counts and cells cover every row.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; a repeated id counts once, with its least (label,
vector); a vector shorter than the longest one counts as filled up with zeros;
scores that a long cannot hold are an error; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_conf, durable

SAMPLE = 16_384             # rows the codebooks are fitted on, about
CELL_ROWS = 512             # rows of a cell, on average, while there are few
MAX_CODES = 128             # codewords of a half
SHARD_VALUES = 2 ** 22      # components in one shard
CHUNK_VALUES = 2 ** 21      # components of the anchors in one chunk
OPEN = 2 ** 62              # end of a window that is open there

WINDOWS = "array<struct<win:int,lo:bigint,hi:bigint>>"


def integer_rows(table: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, v (array<long>): the rows that take part, each id once."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0 ** 62, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for integer scores")).cast("long")))
    return (rows.select("vec_id", F.struct("label", whole.alias("v")).alias("r"))
            .groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v"))


def matrix(lists: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """An Arrow list array as rows of ``width``, short ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = lists.values.to_numpy()[ends[0]:ends[-1]].astype(dtype) if len(lists) else np.zeros(0, dtype)
    out = np.zeros((len(lists), width), dtype)
    if len(lists) and (sizes == width).all():
        return flat.reshape(len(lists), width)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest_code(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the distance to it."""
    near = ((codes ** 2).sum(1) - 2 * x @ codes.T).argmin(1)
    return near, np.sqrt(((x - codes[near]) ** 2).sum(1))


def fit_codes(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from evenly spaced distinct rows; empty codewords stay."""
    start = np.unique(x, axis=0)
    codes = start[np.linspace(0, len(start) - 1, min(k, len(start))).astype(int)].astype(float)
    for _ in range(rounds):
        near, _ = nearest_code(x, codes)
        counts = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
    return codes


@dataclass
class Bounds:
    """What a worker needs to bound scores: codebooks and radii of both halves."""
    half: int
    width: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray   # per non-empty cell: code 1, code 2, first shard, shards
    longest: float      # an upper bound of any row's norm
    dtype: type

    def halves(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) half bounds, anchors x codewords, of both halves; rounding included."""
        slack = 1e-6 + 1e-9 * np.sqrt((q ** 2).sum(1, keepdims=True)) * self.longest
        out = []
        for part, codes, radii in zip((q[:, :self.half], q[:, self.half:]), self.codes, self.radii):
            middle = part @ codes.T
            reach = np.sqrt((part ** 2).sum(1, keepdims=True)) * radii + slack
            out.append((middle + reach, middle - reach))
        return out


@dataclass
class MultiIndex:
    rows: DataFrame  # written: vec_id, label, v, c1, c2, shard
    bounds: Bounds
    chunk_rows: int


def build(rows: DataFrame) -> MultiIndex | None:
    """Index over (vec_id, label, v); None if there are no rows."""
    spark = rows.sparkSession
    arrow_conf(spark)
    rows = durable(rows, "mi-rows")
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(
        F.transform("v", lambda x: F.abs(x))))).first()
    if not n:
        return None
    width, most = max(width, 1), most or 0
    if width * most ** 2 >= 2 ** 62:
        raise ValueError("vectors too large for integer scores")
    dtype = np.float64 if width * most ** 2 < 2 ** 53 else np.int64
    half = max(width // 2, 1)
    every = max(n // SAMPLE, 1)
    sample = matrix(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").toArrow().column("v"), width)
    if not len(sample):
        sample = np.zeros((1, width))
    k = int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, MAX_CODES))
    codes = (fit_codes(sample[:, :half], k), fit_codes(sample[:, half:], k))

    def assign(batches):
        for b in batches:
            x = matrix(b.column(2), width)
            c1, d1 = nearest_code(x[:, :half], codes[0])
            c2, d2 = nearest_code(x[:, half:], codes[1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(d1), pa.array(d2)],
                names=["vec_id", "label", "v", "c1", "c2", "d1", "d2"])

    placed = durable(rows.select("vec_id", "label", "v").mapInArrow(
        assign, "vec_id long, label long, v array<long>, c1 int, c2 int, d1 double, d2 double"), "mi-cells")
    # at most MAX_CODES squared rows
    cells = placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"),
                                           F.max("d2").alias("d2")).orderBy("c1", "c2").collect()
    radii = (np.zeros(len(codes[0])), np.zeros(len(codes[1])))
    for c in cells:
        radii[0][c.c1] = max(radii[0][c.c1], c.d1)
        radii[1][c.c2] = max(radii[1][c.c2], c.d2)
    shard_rows = max(SHARD_VALUES // width, 1)
    table, shard, filled = [], 0, 0
    for c in cells:
        if filled and filled + c.n > shard_rows:
            shard, filled = shard + 1, 0
        pieces = -(-c.n // shard_rows)
        table.append((c.c1, c.c2, shard, pieces))
        if pieces > 1:
            shard, filled = shard + pieces, 0
        else:
            filled += c.n
    where = spark.createDataFrame(table, "c1 int, c2 int, first int, pieces int")
    rows = placed.join(F.broadcast(where), ["c1", "c2"]).select(
        "vec_id", "label", "v", "c1", "c2",
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).alias("shard"))
    longest = float(most) * width ** 0.5
    return MultiIndex(rows, Bounds(half, width, codes, radii, np.array(table, np.int64), longest, dtype),
                      max(CHUNK_VALUES // width, 1))


def route(index: MultiIndex, anchors: DataFrame, first: bool) -> DataFrame:
    """anchors (vec_id, label, v, wins, seen) with ``shards``: the one with the best
    bound, or all others in which some window may still find a row."""
    b = index.bounds

    def run(batches):
        c1, c2, start, pieces = b.cells.T
        for batch in batches:
            q = matrix(batch.column(2), b.width)
            (u1, l1), (u2, l2) = b.halves(q)
            out = []
            for i, (anchor, wins, seen) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(),
                                                         batch.column(4).to_pylist())):
                upper = u1[i][c1] + u2[i][c2]
                if first:
                    best = int(upper.argmax())
                    out.append([int(start[best]) + anchor % int(pieces[best])])
                    continue
                lower = l1[i][c1] + l2[i][c2]
                open_ = np.zeros(len(c1), bool)
                for w in wins:
                    open_ |= (upper >= w["lo"]) & (lower <= w["hi"])
                found = {s for at in np.flatnonzero(open_) for s in range(start[at], start[at] + pieces[at])}
                out.append(sorted(int(s) for s in found - {seen}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "shards"])

    cols = ["vec_id", "label", "v", "wins", "seen"]
    return anchors.select(*cols).mapInArrow(
        run, f"vec_id long, label long, v array<long>, wins {WINDOWS}, seen int, shards array<int>")


def cells_by_bound(upper1: np.ndarray, upper2: np.ndarray):
    """Multi-sequence heap: (bound, place in half 1, place in half 2), falling."""
    o1, o2 = np.argsort(-upper1), np.argsort(-upper2)
    s1, s2 = upper1[o1].tolist(), upper2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap = [(-(s1[0] + s2[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, o1[i], o2[j]
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))
        if j + 1 < len(s2):
            heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))


class _Window:
    """The first k rows of a window so far."""

    def __init__(self, win: int, lo: int, hi: int, k: int):
        self.win, self.lo, self.hi, self.k = win, lo, hi, k
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= self.lo) & (scores <= self.hi)
        if not ok.any():
            return
        ids, scores = np.append(self.ids, ids[ok]), np.append(self.scores, scores[ok])
        best = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:  # nothing below the k-th score counts any more
            self.lo = max(self.lo, self.scores[-1])


def visit(b: Bounds, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray, c1: np.ndarray, c2: np.ndarray,
          anchors: list[tuple], q: np.ndarray, k: int, same: bool) -> list[tuple]:
    """Search one shard's rows for (id, label, windows) anchors: (anchor, win, id, score)
    of each window's first k, and how many cells were scored."""
    have1, at1 = np.unique(c1, return_inverse=True)
    have2, at2 = np.unique(c2, return_inverse=True)
    cell = at1 * len(have2) + at2
    order = np.argsort(cell, kind="stable")
    vec_id, label, x = vec_id[order], label[order], x[order]
    cuts = np.searchsorted(cell[order], np.arange(len(have1) * len(have2) + 1)).tolist()
    (u1, l1), (u2, l2) = b.halves(q.astype(np.float64))
    u1, l1, u2, l2 = u1[:, have1], l1[:, have1], u2[:, have2], l2[:, have2]
    out = []
    for a, (anchor, mine, windows) in enumerate(anchors):
        open_ = [_Window(*w, k) for w in windows]
        every, scored = open_, 0
        for bound, i, j in cells_by_bound(u1[a], u2[a]):
            open_ = [w for w in open_ if bound >= w.lo]
            if not open_:
                break  # every window is certified
            lo, hi = cuts[i * len(have2) + j], cuts[i * len(have2) + j + 1]
            if lo == hi or all(l1[a, i] + l2[a, j] > w.hi for w in open_):
                continue
            scored += 1
            fits = (label[lo:hi] == mine) if same else (label[lo:hi] != mine)
            fits &= vec_id[lo:hi] != anchor
            ids, scores = vec_id[lo:hi][fits], (x[lo:hi] @ q[a])[fits]
            for w in open_:
                w.add(ids, scores)
        out.extend((anchor, w.win, int(i), int(s), scored) for w in every for i, s in zip(w.ids, w.scores))
    return out


HITS = "anchor_id long, win int, vec_id long, score long, scored int"


def _search_shards(index: MultiIndex, routed: DataFrame, k: int, same: bool) -> DataFrame:
    """Local hits of every (shard, chunk of anchors); ``routed`` has ``shards``."""
    b = index.bounds
    total = routed.count()
    chunks = -(-total // index.chunk_rows) or 1
    asked = routed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))).select(
        F.explode("shards").alias("shard"), "chunk", "vec_id", "label", "v", "wins")
    # a shard goes once to every chunk that asks for it
    pairs = asked.select(F.col("shard").alias("wanted"), F.col("chunk").alias("part")).distinct()
    held = index.rows.join(pairs, F.col("shard") == F.col("wanted")).select(
        "shard", F.col("part").alias("chunk"), "vec_id", "label", "v", "c1", "c2")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "win", "vec_id", "score", "scored"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        got = []
        if left.num_rows and right.num_rows:
            wins = [[(w["win"], w["lo"], w["hi"]) for w in ws] for ws in right.column("wins").to_pylist()]
            got = visit(b, left.column("vec_id").to_numpy(), left.column("label").to_numpy(),
                        matrix(left.column("v"), b.width, b.dtype), left.column("c1").to_numpy(),
                        left.column("c2").to_numpy(),
                        list(zip(right.column("vec_id").to_pylist(), right.column("label").to_pylist(), wins)),
                        matrix(right.column("v"), b.width, b.dtype), k, same)
        cols = list(zip(*got)) or [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return held.groupBy("shard", "chunk").cogroup(asked.groupBy("shard", "chunk")).applyInArrow(run, HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: MultiIndex, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchors (vec_id, label, v, wins) -> the first k rows of each window (anchor_id,
    win, rank, vec_id, score), among rows of the anchor's label or of all others."""
    one = durable(route(index, anchors.withColumn("seen", F.lit(-1)), True), "mi-first")
    near = durable(_search_shards(index, one, k, same), "mi-near")
    # the k-th score found raises the lower end of its window
    floor = (_first(near, k).where(F.col("rank") == k)
             .groupBy(F.col("anchor_id").alias("vec_id"))
             .agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("found")))
    raised = one.join(floor, "vec_id", "left").select(
        "vec_id", "label", "v", F.transform("wins", lambda w: F.struct(
            w["win"].alias("win"),
            F.greatest(w["lo"], F.coalesce(F.try_element_at("found", w["win"]), w["lo"])).alias("lo"),
            w["hi"].alias("hi"))).alias("wins"), F.element_at("shards", 1).alias("seen"))
    rest = durable(route(index, raised, False).where(F.size("shards") > 0), "mi-rest")
    far = durable(_search_shards(index, rest, k, same), "mi-far")
    return _first(near.unionByName(far), k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over
    ``integer_rows``: per anchor and positive the first k rows of another label whose
    score is between ``low`` and ``high`` percent of the positive's."""
    index = build(rows)
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = index.rows.where(is_anchor).select("vec_id", "label", "v")
    every = F.array(F.struct(F.lit(0).alias("win"), F.lit(-OPEN).alias("lo"), F.lit(OPEN).alias("hi")))
    found = durable(search(index, anchors.withColumn("wins", every), positives, True).select(
        "anchor_id", F.col("rank").alias("win"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "mi-positives")
    # integer ends: ceil(low * score / 100) and floor(high * score / 100)
    pct = lambda p: F.col("positive_score") * p
    down = lambda c: (c - F.pmod(c, F.lit(100))) / 100
    ends = found.withColumns({"lo": (-down(-pct(low))).cast("long"), "hi": down(pct(high)).cast("long")})
    wins = (ends.where("lo <= hi").groupBy(F.col("anchor_id").alias("vec_id"))
            .agg(F.sort_array(F.collect_list(F.struct("win", "lo", "hi"))).alias("wins")))
    negatives = search(index, anchors.join(wins, "vec_id"), k, False)
    return negatives.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(
        found, ["anchor_id", "win"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")


def mined(table: DataFrame) -> DataFrame:
    """The query's rule: labels of ids divisible by 7 moved on by one, anchors every hundredth id."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_rows(table, label), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
