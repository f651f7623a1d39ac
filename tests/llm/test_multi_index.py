"""Hard-negative mining against a full scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, k=10):
    keep = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        label = (label + 1) % 10 if i % 7 == 0 else label
        keep[i] = min(keep.get(i, (label, v)), (label, v))
    out = []
    for a, (la, va) in keep.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, (lab, v) in keep.items() if i != a)
        for ps, p, _ in [x for x in s if x[2] == la][:positives]:
            hits = [x for x in s if x[2] != la and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:k]
            out.extend((a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(hits))
    return sorted(out)


def got(spark, rows):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, multi_index.mined(spark.createDataFrame(rows, SCHEMA)).select(*cols).collect()))


def clustered(n, seed=3, dims=16, groups=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, dims))
    x = centres[rnd.integers(0, groups, n)] + 0.1 * rnd.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in x[i].astype(np.float32)], int(rnd.integers(0, 10))) for i in range(n)]


def test_random_and_clustered(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rnd.normal(size=8).astype(np.float32)], int(i % 10)) for i in range(400)]
    assert got(spark, rows) == brute(rows)
    rows = clustered(600)
    assert got(spark, rows) == brute(rows)


def test_many_shards_chunks_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_VALUES", 16 * 40)
    monkeypatch.setattr(multi_index, "CHUNK_VALUES", 16 * 2)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 20)
    rows = clustered(500)
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 4) for i in range(250)]  # a third of all rows are one vector
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (1, None, 1), (2, [0.5, None], 1), (3, [nan, 0.5], 1), (4, [inf, 1.0], 1),
            (5, [0.5, 0.5], None), (None, [0.5, 0.5], 1), (6, [0.5, 0.5], 1), (7, [0.25, 0.25], 1), (8, [0.2, 0.3], 2),
            (8, [0.2, 0.3], 2), (8, [0.1, 0.9], 3), (9, [0.3, 0.3, 0.7], 2), (10, [0.4], 4), (11, [], 5),
            (100, [-0.5, -0.5], 2), (101, [-0.5, 0.25], 2), (200, [0.0, 0.0], 9), (201, [0.0, 0.0], 9)]
    padded = [(i, None if e is None else [*e, *[0.0] * (3 - len(e))], c) for i, e, c in rows]
    assert got(spark, rows) == brute(padded) != []
    assert got(spark, rows[:1]) == []
    assert got(spark, []) == []
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "shard", "wins", "r", "label_")})
    assert sorted(map(tuple, multi_index.mined(extra).select("anchor_id").collect())) == sorted((r[0],) for r in brute(padded))


def test_large_components(spark):
    big = [(100, [2.0 ** 16, 1.0], 1), (1, [2.0 ** 16, 3.0], 1), (2, [2.0 ** 15, 5.0], 2), (3, [2.0 ** 15 + 1, 5.0], 2)]
    assert got(spark, big) == brute(big) != []
    with pytest.raises(Exception, match="too large"):
        got(spark, [(0, [2.0 ** 40, 1.0], 1), (1, [1.0, 1.0], 1)])
    with pytest.raises(Exception, match="too large"):
        got(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)])


def test_heap_falls_and_visits_every_cell():
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=7), rnd.normal(size=5)
    seen = list(multi_index.cells_by_bound(a, b))
    bounds = [s for s, _, _ in seen]
    assert bounds == sorted(bounds, reverse=True)
    assert {(i, j) for _, i, j in seen} == {(i, j) for i in range(7) for j in range(5)}
    assert all(s == pytest.approx(a[i] + b[j]) for s, i, j in seen)


def test_windows_stop_early_on_clusters(spark, monkeypatch):
    """With clusters most cells are certified away, and the result is that of a scan."""
    monkeypatch.setattr(multi_index, "CELL_ROWS", 30)
    rows = multi_index.integer_rows(spark.createDataFrame(clustered(4000, dims=8), SCHEMA), F.col("label"))
    index = multi_index.build(rows)
    held = index.rows.toArrow()
    b = index.bounds
    x = multi_index.matrix(held.column("v"), b.width)
    ids, label = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
    pick = np.flatnonzero(ids % 100 == 0)
    anchors = [(int(ids[i]), int(label[i]), [(0, -multi_index.OPEN, multi_index.OPEN)]) for i in pick]
    hits = multi_index.visit(b, ids, label, x, held.column("c1").to_numpy(), held.column("c2").to_numpy(),
                             anchors, x[pick], 5, True)
    scored = {a: n for a, _, _, _, n in hits}
    assert np.mean(list(scored.values())) < 0.5 * len(b.cells)
    for i in pick[:10]:
        s = x @ x[i]
        ok = (label == label[i]) & (ids != ids[i])
        want = sorted(zip((-s[ok]).astype(int).tolist(), ids[ok].tolist()))[:5]
        assert [(-sc, v) for a, _, v, sc, _ in hits if a == ids[i]] == want
