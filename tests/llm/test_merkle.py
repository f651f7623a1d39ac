"""Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import merkle

from .conftest import edge_rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, bump=0):
    d, source, lang, n, text = row
    return H(*map(field, (d, source, lang, n if n is None else n + bump, text)))


def tree(nodes, arity):
    """Top, and per leaf its siblings as (before, after) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            run, j = runs[i // arity], i % arity
            paths[k].append(("".join(run[:j]), "".join(run[j + 1:])))
        level, at = [H(*r) for r in runs], [i // arity for i in at]
    return level[0], paths


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    lower = {g: tree([leaf(r) for r in groups[g]], arity) for g in order}
    root, above = tree([lower[g][0] for g in order], arity)
    out = []
    for g, up in zip(order, above):
        for r, path in zip(groups[g], lower[g][1]):
            path = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, 1 if hit else 0)
            for before, after in path:
                folded = H(before, folded, after)
            out.append((r[0], leaf(r), lower[g][0], root, H(*[b + a for b, a in path]), folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(df, **kw):
    rows = merkle.tamper_report(df, **kw).select("doc_id", "leaf", "subroot", "root", "proof_sha256",
                                                 "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=repr)


def made(n, langs):
    return [(i, None if i % 5 == 0 else f"s{i % 3}", langs[i % len(langs)], None if i % 11 == 0 else i * 3,
             None if i % 13 == 0 else f"text é{i}") for i in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (3, [None, "é", "z", ""]), (37, ["en"]),
                                     (150, ["en", "en", "en", None, "de", "fr"])])
def test_equals_recursion(spark, n, langs):
    rows = made(n, langs)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("arity", [2, 3])
def test_blocks_tiers_and_far_ancestors(spark, monkeypatch, arity):
    """Blocks of four: several tiers, and ancestors spread over the blocks below them."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rows = made(300, ["en", "en", "de", *[f"l{k}" for k in range(7)]])
    assert got(spark.createDataFrame(rows, SCHEMA), arity=arity) == brute(rows, arity)


def test_edge_rows(spark, edge, nothing):
    rows = [(d, None, None, None if t is None else len(t), t) for d, t in edge_rows()]
    assert got(edge) == brute(rows)
    assert merkle.tamper_report(nothing).collect() == []


def test_repeated_ids_and_rows(spark):
    rows = [(7, "a", "en", 1, "x"), (7, "a", "en", 1, "x"), (7, "b", "en", 1, "y"), (7, None, None, None, None),
            (None, None, "en", None, "z"), (None, None, "en", None, "z")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_manifest_proves_and_refutes(spark):
    rows = made(40, ["en", "de"])
    kept = merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA))
    assert kept.where(~merkle.verify(kept)).isEmpty()
    forged = kept.withColumn("leaf", F.when(F.col("doc_id") == 5, F.unhex(F.sha2(F.lit("x").cast("binary"), 256)))
                             .otherwise(F.col("leaf")))
    assert [r.doc_id for r in forged.where(~merkle.verify(forged)).collect()] == [5]
    more = merkle.dataset_manifest(spark.createDataFrame(rows + made(41, ["fr"])[40:], SCHEMA))
    assert more.first().root != kept.first().root


def test_positions_split_a_hot_group(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    rows = merkle.positions(df, "g", ["k"], "hot").collect()
    assert sorted((r.k, r.pos, r.size) for r in rows) == [(i, i, 1000) for i in range(1000)]
