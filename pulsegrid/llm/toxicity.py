"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Folding comes first: lower case, compatibility forms, look-alike letters of other
scripts, digits and signs that stand for letters, accents off; whatever is no
letter then separates words.  Lexicon and text are folded alike.

Training uses the labelled rows, or a hash sample of about ``TRAIN_ROWS`` where
there are more; it counts, over their distinct texts, in how many toxic and clean
texts each term occurs; a term is a word or a word's beginning.
A term's weight is the lower confidence bound of its log-odds, and the terms
above ``LEAST_WEIGHT`` form the lexicon.  Exception phrases are learned next: a
lexicon word with its neighbour that occurs mostly in clean texts; a hit inside
one counts nothing.  The score is a logistic curve of the summed weights of the
best term per word, as they are and per word of the text, fitted on at most
``FIT_ROWS`` training rows.

Bounded by parameters, not by the input: the labelled rows learned from
(``TRAIN_ROWS``), so that their ids can be broadcast and no text is shuffled to
find them, and with them lexicon and phrases, whose terms occur in ``LEAST_TEXTS`` of
them at least; and the rows of the logistic fit (``FIT_ROWS``). Every document is scored.

Defined results: null and empty texts get the score of a text without hits; with
no toxic training row every score is 0; repeated rows are scored each, under a null id
as well; a score of exactly one half is predicted 1; a word of more than
``LONGEST_WORD`` letters is a term by its beginnings only.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, crc_bucket, durable, id_text

TRAIN_ROWS = 100_000
STEMS = (4, 5, 6, 7)
LEAST_WEIGHT = 2.0
LEAST_TEXTS = 5
FIT_ROWS = 40_000
HELD_TERMS = 250_000   # terms a task counts before it emits its partial sums
LONGEST_WORD = 40      # a longer word is a term by its beginnings only

# FIXED VALUES: letters of other scripts, and digits and signs, that pass for a
# Latin letter.  l, 1, | and ! all read as i.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "!": "i", "|": "i", "l": "i", "ł": "i", "ı": "i", "ø": "o",
}
_BREAK = re.compile(r"[\W\d_]+")
_EDGE = re.compile(r"(?<!\w)[!|]+|[!|]+(?!\w)")
_FOLD = str.maketrans(LOOK_ALIKES)


def fold(text: str) -> str:
    """Folded words, one space around each."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "!" in text or "|" in text:
        text = _EDGE.sub(" ", text)  # punctuation at a word's edge stays punctuation
    return f" {_BREAK.sub(' ', text.translate(_FOLD)).strip()} "


def terms_of(word: str) -> list[str]:
    """`` word `` and its beginnings `` wor``, as they stand in folded text."""
    out = [f" {word} "] if len(word) <= LONGEST_WORD else []
    return out + [f" {word[:k]}" for k in STEMS if len(word) > k]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    phrases: frozenset = frozenset()     # (word, next word) pairs
    curve: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -40.0)
    centre: tuple[tuple[float, ...], tuple[float, ...]] = ((0.0,) * 3, (1.0,) * 3)

    @cached_property
    def automaton(self):
        """Built once where it is used; it does not travel to the workers."""
        import ahocorasick
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        machine.make_automaton()
        return machine

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}


def hits(folded: str, lexicon: Lexicon) -> dict[int, float]:
    """Largest weight per start of a hit word (the space before it), exceptions out."""
    if not lexicon.weights:
        return {}
    best: dict[int, float] = {}
    for end, (size, weight) in lexicon.automaton.iter(folded):
        at = end - size + 1
        if weight > best.get(at, 0.0):
            best[at] = weight
    if lexicon.phrases:
        for at in list(best):
            if any(p in lexicon.phrases for p in neighbours(folded, at)):
                del best[at]
    return best


def neighbours(folded: str, at: int) -> list[tuple[str, str]]:
    """The pairs (previous word, word) and (word, next word) of the word after ``at``."""
    end = folded.index(" ", at + 1)
    word = folded[at + 1:end]
    out = []
    if at > 0:
        out.append((folded[folded.rfind(" ", 0, at) + 1:at], word))
    if end + 1 < len(folded):
        out.append((word, folded[end + 1:folded.index(" ", end + 1)]))
    return out


def features(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    folded = fold(text)
    best = hits(folded, lexicon)
    total, words = sum(best.values()), max(1, folded.count(" ") - 1)
    return float(np.log1p(total)), 100 * total / words, max(best.values(), default=0.0)


def _count(rows: DataFrame, key_type: str, found) -> DataFrame:
    """Sum per key of the toxic and clean texts that ``found(text)`` names; texts
    are distinct already.  Partial sums leave a task as soon as it holds many."""
    def run(batches):
        toxic, clean = Counter(), Counter()

        def emit():
            keys = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                 pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if label else clean).update(found(text))
            if len(toxic) + len(clean) > HELD_TERMS:
                yield emit()
                toxic, clean = Counter(), Counter()
        yield emit()

    return (rows.mapInArrow(run, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _bound(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Lower confidence bound of the log-odds that a text with the term is toxic."""
    a, b = toxic + F.lit(0.5), clean + F.lit(0.5)
    return (F.log(a / F.lit(n_toxic + 1.0)) - F.log(b / F.lit(n_clean + 1.0))
            - F.lit(1.5) * F.sqrt(F.lit(1.0) / a + F.lit(1.0) / b))


def learn(labelled: DataFrame) -> Lexicon:
    """labelled (text, toxic 0/1) -> lexicon; texts that occur often count once."""
    spark = labelled.sparkSession
    arrow_conf(spark)
    rows = durable(labelled.where("text IS NOT NULL AND toxic IS NOT NULL")
                   .groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("size"))
                   .agg(F.max_by("text", "toxic").alias("text"), F.max("toxic").alias("toxic"))
                   .select("text", F.col("toxic").cast("int").alias("toxic"), "h"), "toxic-train")
    sizes = {r["toxic"]: r["n"] for r in
             rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return Lexicon()
    pairs = rows.select("text", "toxic")

    def words_in(text):
        return {t for w in set(fold(text).split()) for t in terms_of(w)}

    bound = _bound(F.col("toxic"), F.col("clean"), n1, n0)
    found = (_count(pairs, "string", words_in).where(F.col("toxic") >= LEAST_TEXTS)
             .withColumn("weight", bound).where(F.col("weight") >= LEAST_WEIGHT)
             .orderBy("term").collect())  # bounded by the training rows
    weights = {r["term"]: r["weight"] for r in found}
    # a longer beginning or word says nothing that its beginning does not say as well
    for term in sorted(weights, key=len, reverse=True):
        word = term.strip()
        shorter = [weights[s] for k in STEMS if len(word) > k or (term[-1] != " " and len(word) == k)
                   for s in (f" {word[:k]}",) if s != term and s in weights]
        if shorter and max(shorter) >= weights[term]:
            del weights[term]
    lexicon = Lexicon(weights)

    def phrases_in(text):
        folded = fold(text)
        return {f"{a} {b}" for at in hits(folded, lexicon) for a, b in neighbours(folded, at)}

    odds = _bound(F.col("clean"), F.col("toxic"), n0, n1)
    rare = (_count(pairs, "string", phrases_in).where(F.col("clean") >= LEAST_TEXTS)
            .withColumn("weight", odds).where(F.col("weight") > 0)
            .orderBy("term").collect())
    lexicon.phrases = frozenset(tuple(r["term"].split(" ", 1)) for r in rare)

    share = min(1.0, FIT_ROWS / (n0 + n1))
    sample = pairs if share == 1 else rows.where(
        F.pmod(F.col("h"), F.lit(1_000_003)) < int(share * 1_000_003)).select("text", "toxic")

    def measure(batches):
        for b in batches:
            x = [features(t, lexicon) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[i] for r in x], pa.float64()) for i in range(3)], b.column(1)],
                names=["a", "b", "c", "toxic"])

    got = sample.mapInArrow(measure, "a double, b double, c double, toxic int").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in "abc"], axis=1)
    lexicon.curve, lexicon.centre = fit_curve(x, got.column("toxic").to_numpy().astype(float))
    return lexicon


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
    """Ridge logistic regression on standardised columns by Newton steps."""
    order = np.lexsort([y, *x.T])  # the same sum whatever the order rows came in
    x, y = x[order], y[order]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty,
                               z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist()), (tuple(mean.tolist()), tuple(spread.tolist()))


def score_text(text: str, lexicon: Lexicon) -> float:
    (mean, spread), w = lexicon.centre, lexicon.curve
    z = sum(a * (x - m) / s for a, x, m, s in zip(w, features(text, lexicon), mean, spread)) + w[3]
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))) if lexicon.weights else 0.0


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    arrow_conf(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = np.array([score_text(t, lexicon) for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, predicted int")


def training_labels(labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic of about ``bound`` labelled rows at most, picked by the hash of
    their id; a document that has several labels is toxic if one says so."""
    each = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    grain = 1 << 20
    share = min(1.0, bound / max(1, each.count()))
    return each if share == 1 else each.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(share * grain))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows outside the hold-out fifth, score all rows."""
    held = crc_bucket("doc_id", 5) == 0
    chosen = training_labels(labels.where(~F.coalesce(held, F.lit(True))))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return score(docs, learn(labelled)).select("doc_id", held.alias("held_out"), "score", "predicted")
