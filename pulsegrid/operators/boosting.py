"""Gradient-boosted trees over histograms, one Spark job per tree level.

The method of Spark's ``GBTClassifier`` (logistic loss, regression trees by variance on at
most ``maxBins`` quantile bins, leaves hold the mean residual, first tree with weight 1),
on columns of bin numbers instead of one object per row: a row is 19 bytes for nine
features, and a level costs two additions per pair of features.

Rows lie in blocks of ``BLOCK``, dealt evenly over as many tasks as there are cores (more
only beyond ``TASK_MOST`` rows each). Every task adds up its blocks' histograms (rows and
residuals per node, feature and bin); only their sums reach the driver, which chooses the
splits of the level. Of two sibling nodes only the one with fewer rows is added up, the
other is their parent without it. Residuals are rounded to 2**-18, so that sums are exact and a model
does not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768         # rows; a block's sums of rounded residuals and its row counts share one double
BINS = 32              # of two features, a pair of bin numbers is one code
CHECKPOINT_EVERY = 20  # trees
DIRECT = 64            # tasks whose sums (at most 37 KB each for nine features) the driver adds up itself
TASK_LEAST, TASK_MOST = 150_000, 2_000_000  # rows a task
STORED = StorageLevel.MEMORY_AND_DISK_DESER  # pickled blocks as they are, not serialized once more


class _HasTrees(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0.0 or 1.0", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "weight of every tree after the first", TypeConverters.toFloat)


def _numbers(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", vector_to_array(features))


def bin_edges(df: DataFrame, features: str, n: int) -> tuple[list[list[float]], int]:
    """Upper ends of each feature's bins but the last (between its values if there are at
    most ``BINS``, else quantiles), and the number of rows."""
    def distinct(batches):
        found, rows = [np.empty(0)] * n, 0
        for b in batches:
            rows += b.num_rows
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for i in range(n):
                if found[i] is not None:
                    found[i] = np.union1d(found[i], x[:, i])
                    if len(found[i]) > BINS:
                        found[i] = None
        import pyarrow as pa
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(range(n), pa.int32()),
            "few": pa.array([None if f is None else f.tolist() for f in found], pa.list_(pa.float64())),
            "rows": pa.array([rows] * n, pa.int64())})

    x = _numbers(df, features).select("_x")
    # a null list (too many values in some task) counts as one that is too long
    few = (x.mapInArrow(distinct, "feature int, few array<double>, rows long").groupBy("feature")
           .agg(F.bool_or(F.col("few").isNull()).alias("many"), F.sum("rows").alias("rows"),
                F.array_distinct(F.flatten(F.collect_list("few"))).alias("few"))).collect()
    values = {r.feature: r.few for r in few if not r.many and len(r.few) <= BINS}
    rest = [i for i in range(n) if i not in values]
    cols = x.select(*[F.get("_x", F.lit(i)).alias(f"x{i}") for i in rest]) if rest else None
    ends = cols.approxQuantile([f"x{i}" for i in rest], [k / BINS for k in range(1, BINS)], 0.001) if rest else []
    out = [None] * n
    for i, v in values.items():
        v = np.sort([a for a in v if a == a])
        out[i] = ((v[1:] + v[:-1]) / 2).tolist()
    for i, e in zip(rest, ends):
        out[i] = sorted(set(e))
    return out, few[0].rows


def _tasks(rows: int, cores: int) -> int:
    """One wave of even tasks if the rows allow, else whole waves."""
    wanted = max(-(-rows // TASK_LEAST), 1)
    return wanted if wanted <= cores else cores * -(-rows // (cores * TASK_MOST))


def _members(codes, splits, depth):
    """Per node at ``depth`` the rows in it: ``splits[level]`` holds feature and last left bin
    per node. A few operations on whole columns per node, no look-up per row."""
    low, nodes = codes & np.uint16(BINS - 1), [np.ones(codes.shape[1], bool)]
    for feature, last in splits[:depth]:
        below = []
        for rows, f, b in zip(nodes, feature.tolist(), last.tolist()):
            # the bin of an odd feature stands above that of the feature before it
            right = codes[f // 2] > (b << 5 | 31) if f % 2 else low[f // 2] > b
            below += [rows > right, rows & right]
        nodes = below
    return nodes


def _by_value(fn):
    """The function with what it uses of this module, so that workers need no package."""
    import pickle
    import sys

    from pyspark import cloudpickle
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        sent = cloudpickle.dumps(fn)
    finally:
        cloudpickle.unregister_pickle_by_value(module)
    return lambda it: pickle.loads(sent)(it)


class HistogramBoosting(Estimator, _HasTrees, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", maxDepth=5, maxIter=100, stepSize=0.1):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxDepth=5, maxIter=100, stepSize=0.1)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "HistogramBoostingModel":
        features, label = self.getOrDefault("featuresCol"), self.getOrDefault("labelCol")
        depth, step = self.getOrDefault("maxDepth"), self.getOrDefault("stepSize")
        first = df.select(features).first()
        if first is None:
            raise ValueError("no rows to learn from")
        n = len(first[0])
        edges, rows = bin_edges(df, features, n)
        tasks = _tasks(rows, df.sparkSession.sparkContext.defaultParallelism)
        state = self._blocks(df, features, label, n, edges, tasks).persist(STORED)
        old, trees = [], []
        for t in range(self.getOrDefault("maxIter")):
            if t:
                state = state.mapPartitions(_by_value(_updater(*trees[-1], 1.0 if t == 1 else step)), True)
                state.persist(STORED)
                if t % CHECKPOINT_EVERY == 0 and state.ctx.getCheckpointDir():
                    state.checkpoint()
            splits, values, sums, fewer = [], None, None, None
            for level in range(depth):
                part = state.mapPartitions(_by_value(_histogram(list(splits), level, n, fewer))).treeReduce(
                    np.add, depth=1 if tasks <= DIRECT else 2)
                sums = part if fewer is None else _with_siblings(sums, part, fewer)
                feature, last, values = _best_splits(sums, values)
                fewer = _fewer(sums[0], feature, last)
                splits.append((feature, last))
            trees.append((splits, values))
            old.append(state)  # the first job of a tree has stored its state: the one before can go
            while len(old) > 1:
                old.pop(0).unpersist()
        for s in old:
            s.unpersist()
        flat = [[float(v) for level in splits for part in level for v in part] + [float(v) for v in values]
                for splits, values in trees]
        model = HistogramBoostingModel()
        self._copyValues(model)
        return model._set(edges=edges, trees=flat)

    @staticmethod
    def _blocks(df: DataFrame, features: str, label: str, n: int, edges, tasks: int):
        """Rows as blocks, dealt over the tasks: codes of feature pairs, label, margin, residual
        (of the first tree: the label as -1 or 1)."""
        ends = [np.asarray(e) for e in edges]

        def blocks(batches):
            import pyarrow as pa
            left, rows = [], 0

            def emit(table):
                x = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                y = table.column(1).to_numpy() > 0.5
                codes = np.zeros(((n + 1) // 2, len(y)), np.uint16)
                for i in range(n):
                    codes[i // 2] |= np.searchsorted(ends[i], x[:, i]).astype(np.uint16) << np.uint16(5 * (i % 2))
                return pa.RecordBatch.from_pydict({
                    "rows": pa.array([len(y)], pa.int32()),
                    **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("codes", codes), ("y", y))}})
            for b in batches:
                while b.num_rows:
                    take = b.slice(0, BLOCK - rows)
                    b = b.slice(take.num_rows)
                    left.append(take)
                    rows += take.num_rows
                    if rows == BLOCK:
                        yield emit(pa.Table.from_batches(left))
                        left, rows = [], 0
            if rows:
                yield emit(pa.Table.from_batches(left))

        stored = _numbers(df, features).select("_x", F.col(label).cast("double")).mapInArrow(
            blocks, "rows int, codes binary, y binary")

        def arrays(r):
            y = np.frombuffer(r.y, np.bool_)
            return (np.frombuffer(r.codes, np.uint16).reshape(-1, r.rows), y,
                    np.zeros(r.rows, np.float32), np.where(y, 1, -1).astype(np.float32))
        return stored.repartition(tasks).rdd.map(arrays)


def _histogram(splits, level, n, nodes=None):
    """Blocks -> rows and residuals per (node, feature, bin) of the level, or of these nodes of it."""
    nodes = np.arange(2 ** level) if nodes is None else nodes

    def run(blocks):
        pairs, size = (n + 1) // 2, BINS * BINS
        one = float(2 ** 19)  # a row; |residual| < 4, so a block's residuals stay below half of it
        out = np.zeros((2, len(nodes), 2 * pairs, BINS))
        for codes, _, _, g in blocks:
            w, base, rows = g.astype(np.float64) + one, 0, None
            if level:
                members = _members(codes, splits, level)
                found = [np.flatnonzero(members[i]) for i in nodes]
                rows = np.concatenate(found)
                if not len(rows):
                    continue
                w, base = w.take(rows), np.repeat(np.arange(len(nodes)) * size, [len(f) for f in found])
            for p in range(pairs):
                code = codes[p] if rows is None else codes[p].take(rows)
                both = np.bincount(base + code, w, len(nodes) * size).reshape(-1, BINS, BINS)
                for k in (0, 1):  # sums over a block's rows are exact
                    bins = both.sum(1 + k)
                    count = np.rint(bins / one)
                    out[0, :, 2 * p + k] += count
                    out[1, :, 2 * p + k] += bins - count * one
        yield out[:, :, :n]
    return run


def _updater(splits, values, weight):
    """Blocks -> blocks with this tree's values added to the margins."""
    def run(blocks):
        for codes, y, margin, _ in blocks:
            leaf = np.zeros(len(y), np.min_scalar_type(len(values) - 1))
            for i, rows in enumerate(_members(codes, splits, len(splits))):
                leaf += rows * leaf.dtype.type(i)
            margin = margin + np.float32(weight) * values.astype(np.float32)[leaf]
            sign = np.where(y, 1.0, -1.0)
            g = 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))
            yield codes, y, margin, (np.rint(g * 2 ** 18) / 2 ** 18).astype(np.float32)
    return run


def _fewer(rows, feature, last):
    """Of each node's two children the one with fewer rows."""
    left = np.array([r[f, :b + 1].sum() for r, f, b in zip(rows, feature, last)])
    return 2 * np.arange(len(rows)) + (left > rows[:, 0].sum(1) - left)


def _with_siblings(parents, part, nodes):
    """The sums of all children from their parents' and one child's each."""
    out = np.empty((2, 2 * len(nodes), *part.shape[2:]))
    out[:, nodes], out[:, nodes ^ 1] = part, parents - part
    return out


def _best_splits(sums, before):
    """Per node the split with the greatest gain in variance, and the values of both sides;
    a node without gain sends all rows left and keeps its value."""
    rows, total = sums
    nodes, n, _ = rows.shape
    left_n, left_s = rows.cumsum(2)[:, :, :-1], total.cumsum(2)[:, :, :-1]
    all_n, all_s = rows.sum(2)[:, :, None], total.sum(2)[:, :, None]
    right_n, right_s = all_n - left_n, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s ** 2 / left_n + right_s ** 2 / right_n - all_s ** 2 / all_n
    gain = np.where((left_n > 0) & (right_n > 0), gain, -1.0)
    best = gain.reshape(nodes, -1).argmax(1)
    feature, last = np.divmod(best, BINS - 1)
    at = (np.arange(nodes), feature, last)
    worth = gain[at] > 1e-9 * np.maximum(all_n[:, 0, 0], 1.0)
    feature, last = np.where(worth, feature, 0), np.where(worth, last, BINS - 1)
    own = all_s[:, 0, 0] / np.maximum(all_n[:, 0, 0], 1.0)
    if before is not None:  # a node without rows keeps the value above it
        own = np.where(all_n[:, 0, 0] > 0, own, before)
    sides = [np.where(worth, s[at] / np.maximum(c[at], 1.0), own) for s, c in ((left_s, left_n), (right_s, right_n))]
    return feature, last, np.stack(sides, 1).ravel()


class HistogramBoostingModel(Model, _HasTrees, DefaultParamsReadable, DefaultParamsWritable):
    edges = Param(Params._dummy(), "edges", "bin edges per feature")
    trees = Param(Params._dummy(), "trees", "per tree: features and last left bins by level, then leaf values")

    def margins(self):
        """Column function: array of features -> margin."""
        depth, step = self.getOrDefault("maxDepth"), self.getOrDefault("stepSize")
        ends, n = [np.asarray(e) for e in self.getOrDefault("edges")], len(self.getOrDefault("edges"))
        trees = []
        for flat in self.getOrDefault("trees"):
            flat, splits, at = np.asarray(flat), [], 0
            for level in range(depth):
                k = 2 ** level
                splits.append((flat[at:at + k].astype(np.int64), flat[at + k:at + 2 * k].astype(np.int64)))
                at += 2 * k
            trees.append((splits, flat[at:]))

        def margin(batches):
            import pyarrow as pa
            for a in batches:
                x = a.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                bins = np.stack([np.searchsorted(ends[i], x[:, i]) for i in range(n)]).ravel()
                rows, out = np.arange(len(x)), np.zeros(len(x))
                for t, (splits, values) in enumerate(trees):
                    node = np.zeros(len(x), np.int64)
                    for feature, last in splits:
                        node = 2 * node + (bins[(feature * len(x))[node] + rows] > last[node])
                    out += (step if t else 1.0) * values[node]
                yield pa.array(out)
        from collections.abc import Iterator

        import pyarrow as pa
        margin.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(margin, "double")

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("rawPrediction", self.margins()(vector_to_array(self.getOrDefault("featuresCol"))))
        p = 1.0 / (1.0 + F.exp(-2.0 * F.col("rawPrediction")))
        return (scored.withColumn("_p", p)
                .withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))
