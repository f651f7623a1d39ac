"""Approximate nearest neighbours on low-dimensional stable projections.

Vectors are scaled to length one and projected by ``PROJECTED`` Gaussian (2-stable)
directions.  For a pair at distance d the squared projected distance over d
squared follows a chi-square law, whatever the data; so once the next projected
distance is large against the k-th best true distance found, the chance that a
better neighbour is still unseen is below ``1 - SURE`` and the search stops.

Index.  A kd-tree over the projected points: its upper levels are median splits of
a bounded hash sample and deal all vectors out into cells; a cell that holds more
than ``CELL`` vectors is salted into several.  In each cell the tree goes on down
to buckets.  Every vector is indexed; equal vectors are one point that carries its
k + 1 smallest ids, which is all that a result can need.

Search, in two rounds.  A query first visits its own cell, buckets in order of
projected distance, and verifies true distances until the test holds.  Its k-th
distance then bounds the projected radius, and it visits the other cells within
that radius only.  Queries that meet many in a cell are dealt out in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite numbers
take no part, nor do vectors of another dimension than the most frequent one;
equal queries are searched once; repeated rows count once; rows with a null id take
no part; equal scores go by id, vectors of one direction and any length included; with
fewer than k candidates all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_conf, durable

PROJECTED = 8          # even: the chi-square law has a closed form
SURE = 0.995
CELL = 8192
BUCKET = 128
SAMPLE = 20_000        # projected points that place the upper splits
QUERY_BLOCK = 20_000
ROUNDING = 1e-12       # squared distances this close are told apart by score and id


def chi_square_quantile(p: float, freedom: int) -> float:
    """x with P(chi-square <= x) = p, for an even number of degrees of freedom."""
    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(dim: int, projected: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(1234).standard_normal((dim, projected))


def kd_split(points: np.ndarray, leaf: int):
    """Nested (axis, value, below, above), None at a leaf: medians of the widest axis."""
    if len(points) <= leaf:
        return None
    spread = points.max(axis=0) - points.min(axis=0)
    axis = int(spread.argmax())
    value = float(np.median(points[:, axis]))
    low = points[:, axis] < value
    if not low.any() or low.all():
        return None
    return axis, value, kd_split(points[low], leaf), kd_split(points[~low], leaf)


def kd_cells(tree, projected: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the tree's cells, in order."""
    lows, highs = [], []

    def walk(node, lo, hi):
        if node is None:
            lows.append(lo)
            highs.append(hi)
            return
        axis, value, below, above = node
        left, right = hi.copy(), lo.copy()
        left[axis] = right[axis] = value
        walk(below, lo, left)
        walk(above, right, hi)

    walk(tree, np.full(projected, -np.inf), np.full(projected, np.inf))
    return np.array(lows), np.array(highs)


def home_cells(points: np.ndarray, tree) -> np.ndarray:
    """Number of the cell of each point."""
    out = np.zeros(len(points), np.int64)
    count = 0

    def walk(node, at):
        nonlocal count
        if node is None:
            out[at] = count
            count += 1
            return
        axis, value, below, above = node
        low = points[at, axis] < value
        walk(below, at[low])
        walk(above, at[~low])

    walk(tree, np.arange(len(points)))
    return out


class CellIndex:
    """kd-tree buckets over the projected points of one cell."""

    def __init__(self, unit: np.ndarray, projected: np.ndarray):
        tree = kd_split(projected, BUCKET)
        cell = home_cells(projected, tree)
        self.order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[self.order], np.arange(int(cell.max(initial=-1)) + 2))
        self.spans = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
        self.projected, self.unit = projected[self.order], unit[self.order]
        self.low = np.array([self.projected[a:b].min(axis=0) for a, b in self.spans])
        self.high = np.array([self.projected[a:b].max(axis=0) for a, b in self.spans])

    def nearest(self, unit: np.ndarray, projected: np.ndarray, score, first_id: list, k: int,
                bound: float, reach: float) -> list[tuple[float, int]]:
        """(score, point) of the k nearest found, ties to the smaller ``first_id``; ``score``
        gives a point's exact measure. ``bound``: squared distance of k places known already.

        Distances only choose what is scored: within ``ROUNDING`` of the k-th they are a tie."""
        gap = np.maximum(0, np.maximum(self.low - projected, projected - self.high))
        near = (gap ** 2).sum(axis=1)
        best: list[tuple[float, int, int]] = []  # worst on top
        kth = bound
        for i in np.argsort(near, kind="stable").tolist():
            if near[i] > reach * kth + ROUNDING:  # the stopping test
                break
            a, b = self.spans[i]
            apart = ((self.projected[a:b] - projected) ** 2).sum(axis=1)
            at = np.flatnonzero(apart <= reach * kth + ROUNDING) if kth < np.inf else np.arange(b - a)
            at = at[np.argsort(apart[at], kind="stable")]
            true = ((self.unit[a:b][at] - unit) ** 2).sum(axis=1)
            for d, p, far in zip(true.tolist(), (at + a).tolist(), apart[at].tolist()):
                if far > reach * kth + ROUNDING:
                    break
                if d <= kth + ROUNDING:
                    point = int(self.order[p])
                    entry = (score(point), -first_id[point], point)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k:
                        kth = min(kth, max(2 - 2 * best[0][0], 0.0))
        return [(s, p) for s, _, p in best]


def _valid(vec: Column) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id",
                       vec_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of the rows where
    ``queries`` holds (a condition on ``vec_id``), among all rows but their own."""
    spark = vectors.sparkSession
    arrow_conf(spark, rows=4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("vec")))
    frequent = (rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), "dim").first())
    dim = frequent["dim"] if frequent else 1
    rows = rows.where(F.size("vec") == dim)
    base, reach = directions(dim), chi_square_quantile(sure, PROJECTED)

    # equal vectors: one point with its k + 1 smallest ids (limited before the shuffle)
    nth = Window.partitionBy("vec").orderBy("vec_id")
    few = (rows.dropDuplicates(["vec_id", "vec"]).withColumn("nth", F.row_number().over(nth))
           .where(F.col("nth") <= k + 1))
    points = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def project(batches):
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            p = unit @ base
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array([r.tobytes() for r in p], pa.binary())], names=["ids", "vec", "projected"])

    points = durable(points.select("vec", "ids").mapInArrow(
        project, "ids array<bigint>, vec binary, projected binary")
        .withColumn("point", F.col("ids")[0]), "ann-points")
    total = points.count()
    # bounded: at most about SAMPLE points, picked by their hash
    share = max(1, total // SAMPLE)
    sample = [np.frombuffer(r["projected"]) for r in
              points.where(F.pmod(F.xxhash64("vec"), F.lit(share)) == 0).select("projected").collect()]
    # the tree needs SAMPLE points at most; cells it cannot make small enough are salted
    tree = kd_split(np.array(sample).reshape(-1, PROJECTED),
                    max(8, CELL // share)) if sample else None
    low, high = kd_cells(tree, PROJECTED)

    def locate(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column("projected").to_pylist())).reshape(-1, PROJECTED)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home_cells(p, tree).astype(np.int32))],
                                             names=[*b.schema.names, "cell"])

    placed = durable(points.mapInArrow(locate, "ids array<bigint>, vec binary, projected binary,"
                                               " point long, cell int"), "ann-cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).select(
        "cell", F.expr(f"CAST(ceil(size / {CELL}) AS INT)").alias("parts"))

    asking = rows.where(queries).select("vec_id", "vec").dropDuplicates()
    # the point of each query: its vector's
    bytes_of = asking.select("vec", F.array("vec_id").alias("ids")).mapInArrow(
        project, "ids array<bigint>, vec binary, projected binary")
    query_ids = durable(bytes_of.select(F.col("ids")[0].alias("query_id"), "vec").join(
        placed.select("point", "vec").hint("merge"), "vec").select("query_id", "point"), "ann-queries")
    seekers = durable(placed.join(query_ids.select("point").distinct().hint("merge"), "point", "left_semi")
                      .select(F.col("point").alias("seeker"), "vec", "projected", "cell"), "ann-seekers")

    def search(t: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if t.num_rows and q.num_rows:
            x = np.frombuffer(b"".join(t.column("vec").to_pylist())).reshape(-1, dim)
            norms = np.linalg.norm(x, axis=1)
            p = np.frombuffer(b"".join(t.column("projected").to_pylist())).reshape(-1, PROJECTED)
            index = CellIndex(x / norms[:, None], p)
            ids = t.column("ids").to_pylist()
            first_id = [i[0] for i in ids]
            for seeker, vec, proj, bound in zip(*(q.column(c).to_pylist() for c in
                                                  ("seeker", "vec", "projected", "bound"))):
                v = np.frombuffer(vec)
                length = np.linalg.norm(v)
                for score, i in index.nearest(
                        v / length, np.frombuffer(proj), lambda i: float(np.dot(v, x[i]) / (length * np.linalg.norm(x[i]))),  # noqa: B023
                        first_id, k + 1, np.inf if bound is None else bound, reach):
                    for one in ids[i]:
                        for col, value in zip(out, (seeker, one, score)):
                            col.append(value)
        return pa.table([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()))],
                        names=["seeker", "vec_id", "score"])

    def visit(seeking: DataFrame) -> DataFrame:
        """seeking (seeker, vec, projected, cell, bound): k + 1 best found per cell part."""
        load = (seeking.groupBy("cell").agg(F.count(F.lit(1)).alias("visits"))
                .select("cell", F.expr(f"CAST(ceil(visits / {QUERY_BLOCK}) AS INT)").alias("blocks"))
                .join(sizes, "cell"))
        here = (placed.join(load.hint("merge"), "cell")
                .withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
                .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))))
        there = (seeking.join(load.hint("merge"), "cell")
                 .withColumn("block", F.pmod(F.xxhash64("seeker"), F.col("blocks")).cast("int"))
                 .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))))
        return (here.select("cell", "part", "block", "ids", "vec", "projected")
                .groupBy("cell", "part", "block").cogroup(
                    there.select("cell", "part", "block", "seeker", "vec", "projected", "bound")
                    .groupBy("cell", "part", "block"))
                .applyInArrow(search, "seeker long, vec_id long, score double"))

    by_score = Window.partitionBy("seeker").orderBy(F.desc("score"), "vec_id")
    first = durable(visit(seekers.withColumn("bound", F.lit(None).cast("double")))
                    .withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1), "ann-first")
    kth = (first.groupBy("seeker").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
           .select("seeker", F.expr(f"CASE WHEN n > {k} THEN greatest(2 - 2 * score, 0) END").alias("bound")))

    def further(batches):
        for b in batches:
            out: list[list] = [[], []]
            for seeker, proj, home, bound in zip(*(b.column(i).to_pylist() for i in range(4))):
                p = np.frombuffer(proj)
                gap = np.maximum(0, np.maximum(low - p, p - high))
                near = (gap ** 2).sum(axis=1)
                cells = np.flatnonzero(near <= (np.inf if bound is None else reach * bound + ROUNDING))
                cells = cells[cells != home]
                out[0] += [seeker] * len(cells)
                out[1] += cells.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())],
                                             names=["seeker", "cell"])

    bounded = seekers.join(kth.hint("merge"), "seeker", "left")
    trips = bounded.select("seeker", "projected", "cell", "bound").mapInArrow(further, "seeker long, cell int")
    second = visit(trips.join(bounded.drop("cell").hint("merge"), "seeker"))
    found = first.drop("nth").unionByName(second).dropDuplicates(["seeker", "vec_id", "score"])
    # k + 1 per point, then each query drops itself
    best = found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1)
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (query_ids.join(best.hint("merge"), query_ids["point"] == best["seeker"])
            .where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
