"""Packing token sequences by cutting-stock column generation.

Documents longer than a sequence are cut into full sequences and a remainder; the
lengths of all pieces, rounded up to ``quantum`` tokens, form a histogram.  Rounding
would cost much on pieces of up to ``FINE`` tokens: they are packed among themselves, by
their exact lengths.
A linear program over patterns (multisets of lengths that fit one sequence)
covers the histogram with the fewest sequences: its columns come from knapsack
dynamic programming on the current prices until Farley's bound shows that the
relaxation is within ``gap`` of the optimum.  Fractional pattern counts are
rounded down and the residual lengths packed best-fit decreasing.

The program sees only the histogram, at most ``FINE + capacity / quantum`` numbers
whatever the input size, so it runs on the driver.  Documents never do: pieces
are ranked inside their length class in salted groups (a class with a third of
all pieces is spread over many tasks), and a rank range of a class names the
pattern, its copy and thereby the sequence.  Tokens are not shuffled, only
(id, start, length, checksum) rows.

Defined results: null text counts as empty; every document gets the end id, so
an empty document is one piece of length 1; repeated rows are packed each; a null
id stays null; equal pieces are interchangeable; a text of any length is cut into as
many pieces as it needs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_files import default_path, default_pattern, json_encoder
from .common import arrow_conf, durable, id_text

CAPACITY = 2048
QUANTUM = 8
END_ID = 1
FINE = 64           # pieces up to this length are packed by themselves, exactly
GAP = 0.0005
STALLED = 4         # times the number of lengths: pivots without progress before it stops
ROWS_PER_SALT = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text",
                 pattern: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full sequences and one remainder each."""
    arrow_conf(docs.sparkSession)
    pattern = pattern or default_pattern()

    def cut(batches):
        encode = json_encoder(tokenizer, pattern)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.asarray([*encode(text), end_id], dtype="<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s:s + capacity]
                    for col, v in zip(out, (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in out],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """Largest total price that fits (items repeat), and the items taken."""
    value = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    dense = np.full(room + 1, -1.0)
    dense[sizes] = prices
    index = np.full(room + 1, -1)
    index[sizes] = np.arange(len(sizes))
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        gain = value[c - 1::-1] + dense[1:c + 1]  # item sizes 1..c over room c-1..0
        best = int(gain.argmax())
        if gain[best] > value[c] + 1e-12:
            value[c], pick[c] = gain[best], best + 1
    taken: dict[int, int] = {}
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            i = int(index[pick[c]])
            taken[i] = taken.get(i, 0) + 1
            c -= int(pick[c])
    return float(value[room]), taken


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP):
    """Basic solution of the pattern program: (patterns as columns, amounts)."""
    m = len(sizes)
    base = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(base))
    amount = inverse @ demand
    least, stalled = np.inf, 0
    while True:
        total = float(amount.sum())
        stalled = 0 if total < least - 1e-9 * max(total, 1.0) else stalled + 1
        least = min(least, total)
        if stalled > STALLED * m:  # degenerate pivots may go round in circles; this basis covers all
            return base, amount
        prices = inverse.sum(axis=0)
        worth, taken = knapsack(sizes, prices, room)
        if worth <= 1.0 + gap:  # Farley: no solution is below total / worth
            return base, amount
        column = np.zeros(m)
        for i, k in taken.items():
            column[i] = k
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        amount = np.maximum(amount - theta * step, 0)
        amount[out] = theta
        base[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row


def pack_plan(histogram: dict[int, int], room: int, gap: float = GAP) -> list[tuple[int, int, int, int, int]]:
    """Histogram {size: pieces} -> rank ranges (size, lo, hi, per, sequence).

    Pieces lo..hi-1 of a size go to the sequences from ``sequence`` on, ``per``
    in each.  The number of ranges depends on the number of sizes alone.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    used = np.zeros(len(sizes), dtype=np.int64)
    base, amount = solve_patterns(sizes, left.astype(float), room, gap)
    ranges, sequence = [], 0

    def take(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        for i, per in pattern.items():
            lo = int(used[i])
            used[i] += per * times
            ranges.append((int(sizes[i]), lo, int(used[i]), per, sequence))
        sequence += times

    for p in np.argsort(-amount, kind="stable"):
        column = np.rint(base[:, p]).astype(np.int64)
        items = np.flatnonzero(column)
        times = min(int(np.floor(amount[p] + 1e-6)), int(((left - used)[items] // column[items]).min()))
        if times > 0:
            take({int(i): int(column[i]) for i in items}, times)
    # residual, best fit decreasing: bins by the room they have left
    bins: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        size = int(sizes[i])
        for _ in range(int(left[i] - used[i])):
            free = next((r for r in range(size, room + 1) if bins[r]), room)
            pattern = bins[free].pop() if bins[free] else {}
            pattern[i] = pattern.get(i, 0) + 1
            bins[free - size].append(pattern)
    alike: dict[tuple, int] = {}
    for pattern in (p for group in bins for p in group):
        key = tuple(sorted(pattern.items()))
        alike[key] = alike.get(key, 0) + 1
    for key, number in alike.items():
        take(dict(key), number)
    assert (used == left).all()
    return ranges


def pack(pieces: DataFrame, capacity: int = CAPACITY, quantum: int = QUANTUM,
         gap: float = GAP) -> DataFrame:
    """pieces (doc_id, start, length, ...) -> the same rows with sequence_id and offset."""
    spark = pieces.sparkSession
    # classes: minus the length of a short piece, else the length in quanta
    pieces = durable(pieces.withColumn("size", F.expr(
        f"CAST(CASE WHEN length <= {FINE} THEN -length ELSE ceil(length / {quantum}) END AS INT)")), "pack-pieces")
    histogram = {r["size"]: r["n"] for r in
                 pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= FINE + capacity / quantum
    total = sum(histogram.values())
    ranges = [(-size, *rest) for size, *rest in
              pack_plan({-s: n for s, n in histogram.items() if s < 0}, capacity, gap)]
    used = max((first + -(-(hi - lo) // per) for _, lo, hi, per, first in ranges), default=0)
    ranges += [(size, lo, hi, per, first + used) for size, lo, hi, per, first in
               pack_plan({s: n for s, n in histogram.items() if s > 0}, capacity // quantum, gap)]
    plan = spark.createDataFrame(ranges, "size int, lo long, hi long, per long, first long")

    salts = max(1, -(-total // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = (salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(
                  Window.partitionBy("size").orderBy("salt")
                  .rowsBetween(Window.unboundedPreceding, -1)))
              .select("size", "salt", F.coalesce("before", F.lit(0)).alias("before")))
    own = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (salted.withColumn("nth", F.row_number().over(own) - 1)
              .join(before, ["size", "salt"])
              .withColumn("rank", F.col("nth") + F.col("before")))
    # the plan has at most a few ranges per size, whatever the input
    placed = (ranked.join(F.broadcast(plan.withColumnRenamed("size", "_size")),
                          (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("lo"))
                          & (F.col("rank") < F.col("hi")))
              .withColumn("sequence_id", F.expr("first + (rank - lo) div per")))
    inside = (Window.partitionBy("sequence_id").orderBy("doc_id", "start", "ids_crc32", "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
            .drop("size", "salt", "nth", "before", "rank", "_size", "lo", "hi", "per", "first"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                   quantum: int = QUANTUM, end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col),
                capacity, quantum)
