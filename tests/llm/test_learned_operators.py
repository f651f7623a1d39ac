"""Language, toxicity and nearest neighbours: held-out accuracy, brute force, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language_id, projected_search, registry, toxicity

from .conftest import edge_rows

SF = "/root/testdata/sf0.01"


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---------------------------------------------------------------- language
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = registry.QUERIES["op6_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (held(r.doc_id, 3) == 1) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 3000")
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    by_lang = {}
    for r in docs.select("lang", "text").collect():
        by_lang.setdefault(r.lang, r.text[:2000])
    mixed = spark.createDataFrame([(1, by_lang["en"] + " " + by_lang["de"]), (2, by_lang["fr"])],
                                  "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(mixed, model).collect()}
    assert set(got[1].languages) >= {"en", "de"} and 0.3 < got[1].languages["en"] < 0.7
    assert set(got[2].languages) == {"fr"}


def test_em_recovers_proportions():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(500, 0.1), size=3).T + 1e-9
    n = rng.multinomial(20000, p @ [0.7, 0.3, 0.0] / (p @ [0.7, 0.3, 0.0]).sum()).astype(float)
    share = language_id.infer(n, p)
    assert share[2] == 0 and abs(share[0] - 0.7) < 0.03


def test_language_edge_cases(edge, nothing):
    from pyspark.sql import functions as F
    assert language_id.report(nothing).count() == 0
    unlabelled = language_id.report(edge).collect()
    assert len(unlabelled) == len(edge_rows()) and {r.lang_pred for r in unlabelled} == {"und"}
    labelled = edge.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    got = {r.doc_id: r for r in language_id.report(labelled).collect()}
    assert all(got[i].lang_pred == "und" for i in (1, 2, 3, 21))
    assert all(got[i].lang_pred in ("x", "y") for i in (4, 7, 16, 19, None))
    out = language_id.keep_identified(labelled)
    assert out.columns == edge.columns
    assert not {1, 2, 3, 21} & {r.doc_id for r in out.select("doc_id").collect()}


# ---------------------------------------------------------------- toxicity
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.QUERIES["op5_toxicity"](spark, sf).collect()
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in labels]
    hit = sum(labels[r.doc_id] == 1 and r.predicted == 1 for r in unseen)
    assert hit >= 0.85 * sum(labels[r.doc_id] for r in unseen)
    wrong = sum(labels[r.doc_id] == 0 and r.predicted == 1 for r in unseen)
    assert wrong <= 0.02 * len(unseen)


def test_folding():
    assert toxicity.fold("Y0u Іd10t!!") == toxicity.fold("you idiot")
    assert toxicity.fold("саfé|") == " cafe "
    assert toxicity.fold("") == "  "


def test_exception_phrases_and_disguise(spark):
    clean = [(f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} about clown fish in the sea", 0)
             for i in range(200)]
    bad = [(f"you clown and other {chr(97 + i % 26)}{chr(98 + i // 26)} rude talk", 1) for i in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(clean + bad, "text string, toxic int"))
    assert any("fish" in p for p in lexicon.phrases) or " ciown " not in lexicon.weights
    assert toxicity.score_text("such a rude talk", lexicon) > toxicity.score_text("a clown fish", lexicon)
    assert toxicity.score_text("rudе t4lk", lexicon) == toxicity.score_text("rude talk", lexicon)


def test_toxicity_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(7, 1, 1), (9, 0, 0), (None, 1, 1), (10, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.report(edge, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.report(edge, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.report(nothing, labels).count() == 0


# ---------------------------------------------------------------- neighbours
def brute_neighbours(vectors, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-(float(np.dot(v, w)) / (np.linalg.norm(v) * np.linalg.norm(w))), i)
                        for i, w in vectors if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours_recall(spark):
    got = registry.QUERIES["op2_nearest_neighbours"](spark, SF).collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in
            spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_neighbours(rows, [r for r in rows if r[0] % 50 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(want[q]) & set(found[q])) for q in want)
    assert set(found) == set(want) and hits >= 0.95 * 5 * len(want)
    vec = dict(rows)
    for r in got:
        a, b = vec[r.query_id], vec[r.vec_id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_neighbours_many_cells(spark, monkeypatch):
    monkeypatch.setattr(projected_search, "CELL", 64)
    monkeypatch.setattr(projected_search, "BUCKET", 8)
    monkeypatch.setattr(projected_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16))) for i in range(600)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data], "vec_id long, embedding array<double>")
    got = projected_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    want = brute_neighbours(data, [d for d in data if d[0] % 50 == 0], 5)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(set(want[q]) & found[q]) for q in want) >= 0.9 * 5 * len(want)


def test_neighbours_of_one_direction(spark, monkeypatch):
    """Scaled copies of a vector differ by a rounding step or not at all: score, then id."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=16)
    data = [(i, v * (1 + 0.37 * i)) for i in range(60)] + [(100 + i, rng.normal(size=16)) for i in range(40)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in data], "vec_id long, embedding array<double>")
    want = brute_neighbours(data, [d for d in data if d[0] % 50 == 0], 5)
    for cell in (8192, 16):
        monkeypatch.setattr(projected_search, "CELL", cell)
        monkeypatch.setattr(projected_search, "BUCKET", 8)
        got = projected_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
        for q in (0, 50):
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want[q]


def test_neighbours_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), *[(i, [2.0, 0.0]) for i in range(1, 30)], (50, [0.0, 1.0]), (51, [0.0, 0.0]),
            (52, None), (53, [float("nan"), 1.0]), (54, [None, 1.0]), (55, [1.0, 2.0, 3.0]),
            (56, [float("inf"), 0.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, point string")
    got = projected_search.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    ids = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert ids == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
    assert projected_search.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in projected_search.nearest_neighbours(two, F.col("vec_id") == 0).collect()] == [1]


def test_chi_square_quantile():
    draws = np.random.default_rng(0).chisquare(8, 200_000)
    assert abs((draws <= projected_search.chi_square_quantile(0.95, 8)).mean() - 0.95) < 0.005


# ---------------------------------------------------------------- slow versions
def slow_features(text, weights, phrases):
    """Every word against every term, without an automaton."""
    import math
    words = toxicity.fold(text).split()
    best = []
    for i, w in enumerate(words):
        found = [x for t, x in weights.items() if x > 0 and (t.strip() == w if t.endswith(" ") else w.startswith(t[1:]))]
        pairs = {(words[i - 1], w)} if i else set()
        pairs |= {(w, words[i + 1])} if i + 1 < len(words) else set()
        if found and not pairs & phrases:
            best.append(max(found))
    return math.log1p(sum(best)), 100 * sum(best) / max(1, len(words)), max(best, default=0.0)


def test_toxicity_features_equal_a_slow_version():
    from .conftest import WORDS, prose
    weights = {f" {w[:k]}": 0.5 + i / 7 + k for i, w in enumerate(WORDS[:12]) for k in (4, 5)}
    weights |= {f" {w} ": 3.0 + i for i, w in enumerate(WORDS[8:])} | {f" {'x' * 60} ": 9.0}
    phrases = frozenset({("river", "stone"), ("copper", "morning")})
    lexicon = toxicity.Lexicon(weights, phrases)
    texts = [*[prose(k, 40).translate(str.maketrans("", "", "0123456789")) for k in range(30)],
             "river stone river", "stone river", "R1ver st0ne", "", "x" * 60, "x" * 61, "c0pper morning copper"]
    for t in texts:
        assert toxicity.features(t, lexicon) == pytest.approx(slow_features(t, weights, phrases))


def test_the_automaton_stays_where_it_was_built():
    import pickle
    lexicon = toxicity.Lexicon({" bad ": 2.0})
    assert toxicity.hits(" bad ", lexicon) == {0: 2.0} and "automaton" in vars(lexicon)
    again = pickle.loads(pickle.dumps(lexicon))
    assert "automaton" not in vars(again) and toxicity.hits(" bad ", again) == {0: 2.0}


def slow_language(text, names, p):
    """The same inference with dictionaries and loops."""
    import math
    low = language_id._lower_table()
    codes = [0, *[int(low[ord(c)]) for c in text], 0]
    counts = {}
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            key = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) % 2 ** 64
            key = key * 0xD6E8FEB86659FD93 % 2 ** 64 >> 48
            counts[key] = counts.get(key, 0) + 1
    if not counts:
        return "und", 0.0
    total = sum(counts.values())

    def em(cols):
        share = [1 / len(cols)] * len(cols)
        for _ in range(language_id.ROUNDS):
            new = [0.0] * len(cols)
            for key, n in counts.items():
                joint = [p[key][c] * s for c, s in zip(cols, share)]
                for i, j in enumerate(joint):
                    new[i] += n * j / sum(joint) / total
            moved, share = max(abs(x - y) for x, y in zip(new, share)), new
            if moved < language_id.TOLERANCE:
                break
        return share, sum(n * math.log(sum(p[k][c] * s for c, s in zip(cols, share))) for k, n in counts.items())
    every = list(range(len(names) + 1))
    alone = [sum(n * math.log(p[k][c]) for k, n in counts.items()) for c in every]
    chosen = [max(every, key=lambda c: alone[c])]
    best, share = max(alone), [1.0]
    rough = em(every)[0]
    for c in sorted(every, key=lambda c: -rough[c]):
        if c not in chosen and rough[c] >= 0.01:
            wider = sorted([*chosen, c])
            new, value = em(wider)
            if value - best > language_id.PENALTY * math.log(total + 1):
                chosen, best, share = wider, value, new
    found = {names[c]: s for c, s in zip(chosen, share) if c < len(names)}
    if not found:
        return max(names, key=lambda n: alone[names.index(n)]), 0.0
    lang = max(found, key=found.get)
    return lang, found[lang]


def test_language_equals_a_slow_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    model = language_id.train(docs.where("doc_id % 2 = 0"))
    names, p = list(model), language_id.distributions(model)
    texts = [r.text for r in docs.where("doc_id % 2 = 1").orderBy("doc_id").limit(40).collect()]
    texts += ["", "123 !!", "a", texts[0][:200] + texts[1][:200], "zzqx zzqx qqq"]
    for t, (lang, score, _, _) in zip(texts, language_id.judge(texts, names, p)):
        want, share = slow_language(t, names, p)
        assert lang == want and score == pytest.approx(min(1.0, share), abs=1e-6)
