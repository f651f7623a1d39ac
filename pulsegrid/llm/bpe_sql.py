"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Each worker process holds an in-memory DuckDB with the vocabulary and the merge
table (the splits of a token into two tokens of lower rank, with its rank).  The words a
batch of documents brings in become token-position rows; a recursive query joins
neighbours with the merge table and contracts each word's minimum-rank pair,
leftmost first, until no pair of the word can merge.  An ordered aggregation
gives the ids of a word, and a second one, over the ids joined with the
vocabulary, the bytes they decode to.  A document is the sequence of its words.

One round contracts all occurrences of the word's minimum-rank pair that do not
overlap, counted from the left.  That equals one contraction per round: as every
token of the vocabulary merges from its own bytes by lower ranks (tested), a
merge never opens a pair of lower rank than its own.

Encoded words stay in the worker for later batches, ``MAX_WORDS`` at most; then
the store starts afresh, which changes no result.

A long word is encoded in runs, cut where two bytes stand side by side in no token,
which no merge can cross. Words are told apart by 128 bits of fingerprint.

Defined results: null text is the empty text (no ids); special strings are
ordinary text; repeated rows are encoded each; a null id stays null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretoken
from .bpe_files import default_path, read_ranks
from .common import arrow_conf, id_text
from .token_counts import batches_of

MAX_WORDS = 600_000
BATCH_BYTES = 1_200_000  # of new words in one recursive query
BATCH_CHARS = 3_000_000
BATCH_ROWS = 1536
LONG_WORD = 64  # bytes; longer words are cut into runs first

ENCODE = """
WITH RECURSIVE rounds(word, pos, token, done) AS (
  SELECT word, pos, token, false FROM fresh
  UNION ALL
  (WITH near AS (
     SELECT word, pos, token, lag(token) OVER w AS before, lead(token) OVER w AS following
     FROM rounds WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pairs AS (
     SELECT n.*, m.merged, l.merged AS closed
     FROM near n LEFT JOIN merges m ON m.a = n.token AND m.b = n.following
                 LEFT JOIN merges l ON l.a = n.before AND l.b = n.token),
   best AS (  -- run: pairs of one token may overlap
     SELECT word, min(merged) AS least, coalesce(bool_or(token = following AND before = token), false) AS run
     FROM pairs GROUP BY word),
   chosen AS (SELECT p.*, b.least, b.run FROM pairs p JOIN best b USING (word)),
   straight AS (
     SELECT word, pos, token, least, merged IS NOT DISTINCT FROM least AND least IS NOT NULL AS hit,
            closed IS NOT DISTINCT FROM least AND least IS NOT NULL AS gone
     FROM chosen WHERE NOT run),
   twisted AS (  -- every second pair of a run, from its left end
     SELECT word, pos, token, least, hit, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone
     FROM (
       SELECT word, pos, token, least, merged IS NOT DISTINCT FROM least AND least IS NOT NULL
              AND (nth - max(CASE WHEN merged IS DISTINCT FROM least THEN nth ELSE 0 END)
                         OVER (PARTITION BY word ORDER BY pos)) % 2 = 1 AS hit
       FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS nth FROM chosen WHERE run)))
   -- a word without a pair to merge leaves as done
   SELECT word, pos, CASE WHEN hit THEN least ELSE token END, least IS NULL
   FROM (SELECT * FROM straight UNION ALL SELECT * FROM twisted) WHERE NOT gone)
)
SELECT word, list(token ORDER BY pos) AS ids,
       from_hex(string_agg(digits, '' ORDER BY pos)) AS body
FROM (SELECT word, pos, token FROM rounds WHERE done) JOIN vocabulary USING (token)
GROUP BY word ORDER BY word
"""


@lru_cache(maxsize=1)
def engine(ranks_path: str):
    """DuckDB of this worker process and the words it has encoded."""
    import duckdb
    ranks = read_ranks(ranks_path)
    splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items()
              for i in range(1, len(t)) if ranks.get(t[:i], r) < r and ranks.get(t[i:], r) < r]
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB",
                                             "temp_directory": ""})
    vocabulary = pa.table({"token": pa.array(list(ranks.values()), pa.int32()),
                           "digits": [t.hex() for t in ranks]})
    a, b, merged = (pa.array(x, pa.int32()) for x in zip(*splits))
    for name, rows in (("vocabulary", vocabulary),
                       ("merges", pa.table({"a": a, "b": b, "merged": merged}))):
        con.register("given", rows)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
    single = np.array([ranks[bytes((i,))] for i in range(256)], np.int32)
    return con, (single, pretoken.byte_pairs(ranks)), pretoken.WordStore(MAX_WORDS)


def encode_words(words: list[bytes], ranks_path: str) -> list[tuple[bytes, bytes]]:
    """(ids as little-endian unsigned 32-bit integers, bytes they decode to) per word."""
    con, (single, _), _ = engine(ranks_path)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    con.register("fresh", pa.table({
        "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
        "pos": (np.arange(int(sizes.sum())) - np.repeat(first, sizes)).astype(np.int32),
        "token": single[np.frombuffer(b"".join(words), np.uint8)]}))
    got = con.sql(ENCODE).to_arrow_table().combine_chunks()
    con.unregister("fresh")
    lists = got.column("ids").chunk(0)
    flat, cut = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    raw = flat.tobytes()
    return [(raw[4 * a:4 * b], body) for a, b, body in
            zip(cut[:-1].tolist(), cut[1:].tolist(), got.column("body").to_pylist())]


def encode_long(words: list[bytes], ranks_path: str) -> list[tuple[bytes, bytes]]:
    """``encode_words`` in bounded batches; a long word goes in runs, which no merge crosses."""
    beside = engine(ranks_path)[1][1]
    parts = [pretoken.runs(w, beside) if len(w) > LONG_WORD else [w] for w in words]
    flat = [r for p in parts for r in p]
    fill = np.cumsum([len(r) for r in flat]) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(fill)) + 1).tolist(), len(flat)]
    done = [x for lo, hi in zip(cuts, cuts[1:]) for x in encode_words(flat[lo:hi], ranks_path)]
    if len(flat) == len(words):
        return done
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return [tuple(b"".join(x) for x in zip(*done[a:z])) for a, z in zip([0, *ends], ends)]


def encode_texts(texts: list[str], ranks_path: str) -> list[tuple[bytes, bytes]]:
    """(ids, decoded bytes) per text."""
    known = engine(ranks_path)[2]
    starts, ends, doc, prints, checks = pretoken.words(texts)
    if not len(starts):
        return [(b"", b"")] * len(texts)
    joined = "\0".join(texts)  # one separator where the layout has its sentinel
    pairs, where = known.values(prints, checks, lambda at: encode_long(
        [joined[starts[i]:ends[i]].encode() for i in at], ranks_path))
    ids = np.empty(len(pairs), object)
    bodies = np.empty(len(pairs), object)
    ids[:] = [p[0] for p in pairs]
    bodies[:] = [p[1] for p in pairs]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    return [(b"".join(ids[w].tolist()), b"".join(bodies[w].tolist()))
            for w in (where[a:b] for a, b in zip(cuts, cuts[1:]))]


def encode_documents(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary); with ``digests`` the count and
    SHA-256 of both instead, so that ids need not leave the worker."""
    arrow_conf(docs.sparkSession, rows=BATCH_ROWS)
    ranks = ranks or default_path("byte_bpe_50k.tiktoken")

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [x for lo, hi in batches_of(texts, BATCH_CHARS)
                   for x in encode_texts(texts[lo:hi], ranks)]
            if digests:
                cols = [pa.array([len(i) // 4 for i, _ in out], pa.int64()),
                        *[pa.array([hashlib.sha256(x[k]).hexdigest() for x in out], pa.string())
                          for k in (0, 1)]]
            else:
                cols = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in out],
                                 pa.list_(pa.int32())),
                        pa.array([d for _, d in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    names, schema = ((["n_tokens", "ids_sha256", "decoded_sha256"],
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string") if digests
                     else (["ids", "decoded"], "doc_id long, ids array<int>, decoded binary"))
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
