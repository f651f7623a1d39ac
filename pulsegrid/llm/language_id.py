"""Language identification as multilingual mixture inference.

Each learned language is a distribution over letter trigrams (word borders
included), counted over all training rows; one uniform background component
stands for text in none of them.  For a document, expectation-maximisation
estimates the proportion of each language from its trigram counts.  The set of
languages grows from the best single one; another language is taken in only if
the log-likelihood rises by more than ``PENALTY * log(n)`` (n trigrams).  The
prediction is the language with the largest proportion.

The counts are exact over all training rows: partial sums per partition, then
one aggregation by (language, trigram bucket).  What reaches the driver and the
tasks is one table of languages x ``BUCKETS``, whatever the input size.

Defined results: null text, or text without a letter, is ``und`` with score 0;
so is every text if no training row has a language.  Null languages take no
part in training; repeated rows are counted and predicted each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import arrow_conf, crc_bucket, id_text
from .token_counts import batches_of

BUCKETS = 1 << 16
SMOOTH = 0.05          # share of the background in every language's distribution
PENALTY = 2.0
ROUNDS = 25
TOLERANCE = 1e-4
LANGS_HELD = 32        # languages whose partial counts a task holds before it emits them
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other characters."""
    letters = np.flatnonzero(pretoken.class_table() == pretoken.L)
    table = np.zeros(pretoken.END_CODE + 1, np.uint32)
    for c in letters.tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every trigram that has a letter in its middle."""
    codes = _lower_table()[pretoken.lay_out(texts)]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    middle = np.flatnonzero(codes)
    doc = np.searchsorted(ends, middle)
    with np.errstate(over="ignore"):
        around = np.concatenate([np.zeros(1, np.uint32), codes])  # [i] is left of i
        key = (around[middle].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               ^ codes[middle].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
               ^ codes[middle + 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        key *= np.uint64(0xD6E8FEB86659FD93)
    return (key >> np.uint64(64 - 16)).astype(np.int64), doc


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Trigram counts per language over all given rows."""
    arrow_conf(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def emit(held):
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(counts[at])], names=["lang", "bucket", "n"])

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                bucket, doc = trigrams(texts[lo:hi])
                names, number = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                grid = np.bincount(number[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for name, own in zip(names.tolist(), grid.reshape(len(names), BUCKETS)):
                    held[name] = held[name] + own if name in held else own.copy()
                if len(held) > LANGS_HELD:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    sums = (rows.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    model: dict[str, np.ndarray] = {}
    got = sums.toArrow()
    langs = np.array(got.column("lang").to_pylist(), object)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    for lang in sorted(set(langs.tolist())):
        mine = langs == lang
        model[lang] = np.bincount(bucket[mine], weights=n[mine], minlength=BUCKETS)
    return model


def distributions(model: dict[str, np.ndarray]) -> np.ndarray:
    """BUCKETS x (languages + background) probabilities."""
    cols = [(1 - SMOOTH) * c / c.sum() + SMOOTH / BUCKETS for c in model.values()]
    return np.ascontiguousarray(np.stack([*cols, np.full(BUCKETS, 1 / BUCKETS)], axis=1))


def mix(n: np.ndarray, p: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood."""
    total, share = n.sum(), start
    for _ in range(ROUNDS):
        joint = p * share
        new = (n / joint.sum(axis=1)) @ joint / total
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Proportions over the selected set (0 outside), background last."""
    k = p.shape[1]
    alone = n @ np.log(p)
    chosen = [int(alone.argmax())]
    best, share = float(alone.max()), np.ones(1)
    rough = mix(n, p, np.full(k, 1 / k))[0]
    bar = PENALTY * np.log(n.sum() + 1)
    for c in np.argsort(-rough, kind="stable").tolist():
        if c in chosen or rough[c] < 0.01:
            continue
        wider = sorted([*chosen, c])
        new, value = mix(n, p[:, wider], np.full(len(wider), 1 / len(wider)))
        if value - best > bar:
            chosen, best, share = wider, value, new
    out = np.zeros(k)
    out[chosen] = share
    return out


def judge(texts: list[str], names: list[str], p: np.ndarray | None):
    """(language, score, proportions, background) per text."""
    for lo, hi in batches_of(texts):
        bucket, doc = trigrams(texts[lo:hi])
        cuts = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
        for a, z in zip(cuts, cuts[1:]):
            if a == z or p is None:
                yield UNKNOWN, 0.0, {}, 0.0
                continue
            own = np.bincount(bucket[a:z], minlength=BUCKETS)
            at = np.flatnonzero(own)
            share = infer(own[at].astype(float), p[at])
            found = {x: float(s) for x, s in zip(names, share) if s > 0}
            if found:
                lang = max(found, key=found.get)
                yield lang, min(1.0, found[lang]), found, float(share[-1])
            else:  # the background alone: still the likeliest language
                yield names[int((own[at] @ np.log(p[at, :-1])).argmax())], 0.0, {}, 1.0


def lettered(texts: list[str]) -> list[bool]:
    out: list[bool] = []
    for lo, hi in batches_of(texts):
        doc = trigrams(texts[lo:hi])[1]
        out += (np.bincount(doc, minlength=hi - lo) > 0).tolist()
    return out


def _share(docs: DataFrame, model: dict[str, np.ndarray]):
    """The model in every task: languages x BUCKETS numbers."""
    return docs.sparkSession.sparkContext.broadcast(distributions(model) if model else None)


def predict(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (language -> proportion), background."""
    arrow_conf(docs.sparkSession)
    names, shared = list(model), _share(docs, model)

    def run(batches):
        for b in batches:
            lang, score, found, back = zip(*judge(b.column(1).to_pylist(), names, shared.value)
                                           ) if b.num_rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64())),
                 pa.array(back, pa.float64())],
                names=["doc_id", "lang_pred", "score", "languages", "background"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, languages map<string,double>,"
             " background double")


def identify(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, predict all."""
    held_out = crc_bucket(id_col, 3) == 1 if held_out is None else held_out
    model = train(docs.where(~F.coalesce(held_out, F.lit(False))), text_col, lang_col)
    return predict(docs, model, id_col, text_col)


def report(docs: DataFrame) -> DataFrame:
    return identify(docs).select(
        "doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, most_background: float = 0.5,
                    text_col: str = "text") -> DataFrame:
    """docs without rows of no language: no letter, or mostly background. Where no
    row has a language to learn from, every text with a letter is kept.

    Whole rows pass through the task that judges them; nothing is shuffled.
    """
    model = train(docs.where(~F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))), text_col)
    arrow_conf(docs.sparkSession)
    names, shared, at = list(model), _share(docs, model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            keep = lettered(texts) if shared.value is None else [
                lang != UNKNOWN and back <= most_background
                for lang, _, _, back in judge(texts, names, shared.value)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
