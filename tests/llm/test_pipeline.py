"""The pipeline's stages in order, held against brute-force versions."""

import duckdb

import corpus_pipeline
from pulsegrid.llm import language_id, packing, registry

from .test_text_operators import LOW, brute_components, brute_secrets, sets_of

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "near dedup", "secret scan", "packing"]

    step = stage["language ID"](spark, docs, SF)
    judged = {r.doc_id: r for r in language_id.identify(docs).collect()}
    want = {i for i in rows if judged[i].lang_pred != "und" and judged[i].background <= 0.5}
    assert {r.doc_id for r in step.collect()} == want

    step = stage["exact dedup"](spark, step, SF)
    last = {}
    for i in sorted(want):
        last[(rows[i].text or "").translate(LOW)] = i
    assert {r.doc_id for r in step.collect()} == set(last.values())

    step = stage["near dedup"](spark, step, SF)
    comp = brute_components(sets_of([(i, rows[i].text) for i in last.values()]), 85)
    want = {i for i, c in comp.items() if i == c}
    assert {r.doc_id for r in step.collect()} == want

    step = stage["secret scan"](spark, step, SF)
    assert step.columns == docs.columns
    got = {r.doc_id: r.text for r in step.collect()}
    assert set(got) == want
    for i in want:
        found = brute_secrets(rows[i].text or "")
        assert ("[SECRET]" in (got[i] or "")) >= bool(found)
        assert not found or not brute_secrets(got[i])

    packed = stage["packing"](spark, step, SF).collect()
    assert {r.doc_id for r in packed} == want
    assert [tuple(sorted(r.asDict())) for r in packed[:1]] == [tuple(sorted(packing.pack_documents(docs).columns))]


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    total = rows.selectExpr("sum(length) t", "count(distinct sequence_id) s").first()
    assert total.s * 2048 >= total.t


def test_stages_take_edge_cases(spark, edge, nothing):
    from pyspark.sql import functions as F
    labelled = edge.withColumn("lang", F.lit("en"))
    for docs in (nothing, labelled):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.count()


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.ORACLES.items():
        got = registry.QUERIES[name](spark, SF).toArrow().to_pylist()
        want = con.sql(sql).to_arrow_table().to_pylist()
        key = lambda r: sorted((k, str(v)) for k, v in r.items())
        assert sorted(map(key, got)) == sorted(map(key, want)), name


def test_language_stage_without_any_language(spark):
    """Nothing to learn from: texts with a letter stay, whatever their script."""
    texts = ["plain words here", "école", "中文 文字", "12345 !!!", "", None, "a"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string")
    kept = language_id.keep_identified(docs).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 6]
    assert language_id.keep_identified(docs.limit(0)).count() == 0
