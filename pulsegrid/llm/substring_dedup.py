"""Removing passages that repeat across documents, with an FM-index per shard.

A passage is a window of ``WINDOW`` consecutive words.  Each word covered by a
window that also stands in a document with a smaller id goes.  Windows are judged
on the input.

Routing.  Every window has a minimizer, the smallest hash among its word
``GRAM``-grams; equal windows have equal minimizers at equal places.  So the
windows of a document fall into segments, one per minimizer, and only segments
with the same minimizer can share a window.  Minimizers of one document alone
leave the job before any text moves.  Documents with the same word sequence as a
smaller one are settled by that alone and take no further part.

Collapse.  Equal segments are one, owned by its smallest document (pre-aggregated);
the other holders lose all its windows.  A minimizer that still has more than
``HOT`` different segments has them split: windows at neighbouring distances from
the minimizer stay together (``SPLITS``: five, then single ones) and are dealt out
anew by the words they all share.  Pieces outside the common passage become
single and leave, pieces inside become equal and collapse.

Shards.  What is left is dealt out by minimizer.  Each shard builds a compressed
FM-index (wavelet matrix over the word symbols) of its pieces and streams them
through backward search: matching statistics restricted to smaller documents,
reported where they reach the window length.

Words are compared by 32 bits of their hash: different windows pass for equal
only if every word that differs collides.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; rows that share an id are one document, which never makes itself
lose words; rows with a null id neither lose words nor cost others any.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, durable, id_text
from .fm_index import SegmentIndex
from .token_counts import batches_of
from .wordhash import mixed, word_hashes

WINDOW = 50
GRAM = 10
HOT = 1000
SPLITS = (5, 1)
SHARD_WORDS = 400_000

_rng = np.random.default_rng(7)
_PLACES = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MINIMIZER = np.dtype([("m", "<i8"), ("a", "<i4")])
_EMPTY = hashlib.sha256(b"").hexdigest()


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out += h[i:i + len(out)] * _PLACES[i]
    return mixed(out)


def minimizers(grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, a) per segment: its windows start at a up to the next segment's a - 1;
    and the place of each minimizer."""
    span = window - gram + 1
    starts = len(grams) - span + 1
    step = 4096
    place = np.concatenate([
        np.lib.stride_tricks.sliding_window_view(grams[s:s + step + span - 1], span).argmin(axis=1)
        + np.arange(s, min(s + step, starts)) for s in range(0, starts, step)])
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out = np.empty(len(first), _MINIMIZER)
    out["m"], out["a"] = grams[place[first]].view(np.int64), first
    return out, place[first]


def sketch_documents(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, n_words, print (of the word sequence), kept_sha256 (nothing removed),
    segments (m and a per segment)."""
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            cols: list[list] = [[], [], [], []]
            for lo, hi in batches_of(texts):
                bodies = [t.encode() for t in texts[lo:hi]]
                h, cuts = word_hashes(bodies)
                for body, a, z in zip(bodies, cuts[:-1].tolist(), cuts[1:].tolist()):
                    own = h[a:z]
                    cols[0].append(z - a)
                    cols[1].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    cols[2].append(hashlib.sha256(b" ".join(body.split())).hexdigest())
                    cols[3].append(minimizers(rolling(own, gram), window, gram)[0].tobytes()
                                   if z - a >= window else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())],
                names=["doc_id", "n_words", "print", "kept_sha256", "segments"])

    return docs.mapInArrow(run, "doc_id long, n_words long, print binary, kept_sha256 string,"
                                " segments binary")


def explode_segments(owners: DataFrame) -> DataFrame:
    """m, doc_id, print, a: one row per segment."""
    def run(batches):
        for b in batches:
            parts = [np.frombuffer(x, _MINIMIZER) for x in b.column(2).to_pylist()]
            sizes = [len(p) for p in parts]
            every = np.concatenate(parts) if parts else np.zeros(0, _MINIMIZER)
            at = pa.array(np.repeat(np.arange(len(parts)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(every["m"])), b.column(0).take(at), b.column(1).take(at),
                 pa.array(np.ascontiguousarray(every["a"]))], names=["m", "doc_id", "print", "a"])

    return owners.select("doc_id", "print", "segments").mapInArrow(
        run, "m long, doc_id long, print binary, a int")


def cut_segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """m, doc_id, print, a, rel (of the minimizer), words (32-bit hashes): the
    segments named in ``wanted``."""
    def run(batches):
        for b in batches:
            ids, prints = b.column(0).to_pylist(), b.column(1).to_pylist()
            bodies, wanted = [t.encode() for t in b.column(2).to_pylist()], b.column(3).to_pylist()
            h, cuts = word_hashes(bodies)
            cols: list[list] = [[], [], [], [], [], []]
            for i, keep in enumerate(wanted):
                own = h[cuts[i]:cuts[i + 1]]
                if hashlib.blake2b(own.tobytes(), digest_size=16).digest() != prints[i]:
                    continue  # another text under the same id
                found, places = minimizers(rolling(own, gram), window, gram)
                last = np.append(found["a"][1:], len(own) - window + 1) + window - 1
                short = (own >> np.uint64(32)).astype("<u4")
                for a in set(keep):
                    k = int(np.searchsorted(found["a"], a))
                    for col, v in zip(cols, (int(found["m"][k]), ids[i], prints[i], a,
                                             int(places[k]) - a, short[a:last[k]].tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32(),
                                                       pa.int32(), pa.binary()))],
                names=["m", "doc_id", "print", "a", "rel", "words"])

    return texts.select("doc_id", "print", "text", "wanted").mapInArrow(
        run, "m long, doc_id long, print binary, a int, rel int, words binary")


def split_pieces(rows: DataFrame, window: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` windows at neighbouring distances from the
    minimizer, under a new m: a hash of the words that all such windows share."""
    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for content, owner, shift, m, rel, words in zip(*(b.column(i).to_pylist() for i in range(6))):
                windows = len(words) // 4 - window + 1
                for c in range((rel - windows + 1) // size, rel // size + 1):
                    s0, s1 = max(0, rel - size * c - size + 1), min(windows - 1, rel - size * c)
                    share = rel - size * c
                    key = words[4 * share:4 * (share + window - size + 1)]
                    new = hashlib.blake2b(m.to_bytes(8, "little", signed=True) + bytes((c,)) + key,
                                          digest_size=8).digest()
                    for col, v in zip(cols, (content, owner, shift + s0, int.from_bytes(new, "little", signed=True),
                                             rel - s0, words[4 * s0:4 * (s1 + window)])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int32(), pa.int64(),
                                                       pa.int32(), pa.binary()))],
                names=PIECE)

    return rows.select(*PIECE).mapInArrow(
        run, "content binary, owner long, shift int, m long, rel int, words binary")


PIECE = ["content", "owner", "shift", "m", "rel", "words"]


def _digest(*cols) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*[F.col(c).cast("string").cast("binary") if c == "m"
                                                 else F.col(c) for c in cols]), 256), 1, 32))


def resolve(tops: DataFrame, window: int) -> DataFrame:
    """tops (content, owner, m, rel, words) -> content, first, last: the stretches
    of each that a smaller owner has as well."""
    rows = tops.withColumn("shift", F.lit(0)).select(*PIECE)
    settled, calm = [], []
    for size in (*SPLITS, None):
        several = (rows.groupBy("m").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
                   .where("lo < hi").select("m"))
        rows = durable(rows.join(several.hint("merge"), "m", "left_semi")
                       .withColumn("piece", _digest("m", "words")), "passage-pieces")
        pieces = durable(rows.groupBy("piece").agg(F.min("owner").alias("least"), F.first("m").alias("m")),
                         "passage-least")
        placed = rows.join(pieces.select("piece", "least").hint("merge"), "piece")
        settled.append(placed.where("owner > least").select(
            "content", F.col("shift").alias("first"),
            F.expr("shift + CAST(length(words) / 4 AS INT) - 1").alias("last")))
        first = placed.where("owner = least")
        hot = durable(pieces.groupBy("m").agg(F.count(F.lit(1)).alias("c"))
                      .where(F.col("c") > HOT).select("m"), "passage-hot")
        if size is None or hot.isEmpty():
            calm.append(first.select(*PIECE, "piece"))
            break
        calm.append(first.join(hot.hint("merge"), "m", "left_anti").select(*PIECE, "piece"))
        rows = split_pieces(first.join(hot.hint("merge"), "m", "left_semi"), window, size)
    left = durable(reduce(DataFrame.unionByName, calm), "passage-calm")
    distinct = left.groupBy("piece").agg(F.first("m").alias("m"), F.first("owner").alias("owner"),
                                         F.first("words").alias("words"))
    # a minimizer with one piece left has nothing to be searched in
    alone = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m")
    distinct = durable(distinct.join(alone.hint("merge"), "m", "left_semi"), "passage-distinct")
    total = distinct.agg(F.sum(F.length("words") / 4)).first()[0] or 0
    found = search_shards(distinct, window, max(1, -(-int(total) // SHARD_WORDS)))
    searched = left.select("content", "shift", "piece").join(found.hint("merge"), "piece").select(
        "content", F.expr("shift + first").alias("first"), F.expr("shift + last").alias("last"))
    return reduce(DataFrame.unionByName, [*settled, searched])


def search_shards(distinct: DataFrame, window: int, shards: int) -> DataFrame:
    """piece, first, last: stretches that a smaller owner has as well."""
    def run(t: pa.Table) -> pa.Table:
        words = [np.frombuffer(w, "<u4") for w in t.column("words").to_pylist()]
        seg, first, last = SegmentIndex(words, t.column("owner").to_numpy()).covered(window)
        return pa.table({"piece": t.column("piece").take(pa.array(seg)),
                         "first": first.astype(np.int32), "last": last.astype(np.int32)})

    return (distinct.withColumn("shard", F.pmod("m", F.lit(shards)))
            .select("shard", "piece", "owner", "words")
            .groupBy("shard").applyInArrow(run, "piece binary, first int, last int"))


def repeated_stretches(segments: DataFrame, window: int) -> DataFrame:
    """doc_id, print, first, last (word numbers) of what goes."""
    segments = durable(segments.withColumn("content", _digest("m", "words")), "passage-segments")
    tops = durable(segments.groupBy("content").agg(
        F.min("doc_id").alias("owner"), F.first("m").alias("m"), F.first("rel").alias("rel"),
        F.first("words").alias("words")), "passage-tops")
    holders = segments.select("content", "doc_id", "print", "a", (F.length("words") / 4).cast("int").alias("size"))
    placed = holders.join(tops.select("content", "owner").hint("merge"), "content")
    whole = placed.where("doc_id > owner").select(
        "doc_id", "print", F.col("a").alias("first"), F.expr("a + size - 1").alias("last"))
    part = placed.where("doc_id = owner").join(resolve(tops, window).hint("merge"), "content").select(
        "doc_id", "print", F.expr("a + first").alias("first"), F.expr("a + last").alias("last"))
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``texts_out`` also the kept text."""
    arrow_conf(docs.sparkSession)
    docs = id_text(docs, id_col, text_col)
    known = durable(sketch_documents(docs, window, gram), "passage-documents")
    firsts = (known.where("segments IS NOT NULL AND doc_id IS NOT NULL")
              .groupBy("print").agg(F.min("doc_id").alias("first")))
    tagged = known.join(firsts.hint("merge"), "print", "left")
    # one row per document and text: rows that repeat both are the same segments
    owners = tagged.where("doc_id = first").select("doc_id", "print", "segments").dropDuplicates(["print"])
    rows = explode_segments(owners)
    shared = (rows.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .where("lo < hi").select("m"))
    wanted = durable(rows.join(shared.hint("merge"), "m", "left_semi")
                     .groupBy("doc_id", "print").agg(F.collect_set("a").alias("wanted")), "passage-wanted")
    texts = durable(docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "print", "text", "wanted"),
                    "passage-texts")
    segments = cut_segments(texts.dropDuplicates(["doc_id", "print", "text"]), window, gram)
    gone = (repeated_stretches(segments, window)
            .groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "last")).alias("gone")))

    def rewrite(batches):
        for b in batches:
            cols: list[list] = [[], [], []]
            for text, pr, gaps in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.encode().split()
                dead = np.zeros(len(words) + 1, np.int64)
                for g in gaps:
                    dead[g["first"]] += 1
                    dead[g["last"] + 1] -= 1
                dead = np.cumsum(dead)[:-1] > 0
                kept = b" ".join(w for w, d in zip(words, dead.tolist()) if not d)
                for col, v in zip(cols, (int(dead.sum()), hashlib.sha256(kept).hexdigest(),
                                         kept.decode() if texts_out else None)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.string())], names=["doc_id", "print", "cut", "sha", "kept_text"])

    def right_text(batches):  # rows that repeat an id with another text are not this print's
        for b in batches:
            h, cuts = word_hashes([t.encode() for t in b.column(1).to_pylist()])
            yield b.filter(pa.array([
                hashlib.blake2b(h[a:z].tobytes(), digest_size=16).digest() == p for a, z, p in
                zip(cuts[:-1].tolist(), cuts[1:].tolist(), b.column(2).to_pylist())], pa.bool_()))

    changed = texts.select("doc_id", "text", "print").join(
        gone.hint("merge"), ["doc_id", "print"]).select("doc_id", "text", "print", "gone")
    changed = (changed.mapInArrow(right_text, changed.schema)
               .mapInArrow(rewrite, "doc_id long, print binary, cut long, sha string, kept_text string")
               .dropDuplicates(["doc_id", "print"]))
    copy = "first IS NOT NULL AND doc_id > first"
    out = tagged.drop("segments").join(changed.hint("merge"), ["doc_id", "print"], "left").select(
        "doc_id", "n_words",
        F.expr(f"CASE WHEN {copy} THEN n_words ELSE coalesce(cut, 0) END").alias("n_removed"),
        F.expr(f"CASE WHEN {copy} THEN '{_EMPTY}' ELSE coalesce(sha, kept_sha256) END").alias("kept_sha256"),
        *([F.expr(f"CASE WHEN {copy} THEN '' ELSE kept_text END").alias("kept_text")] if texts_out else []))
    return out
