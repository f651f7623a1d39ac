"""Token counts by compiled finite-state transducers.

Two deterministic transducers replace the tokenizer.  The first splits text into
words (``pretoken``): chunk state maps, composed by a parallel prefix scan.  The
second reads the bytes of a word; each transition carries the number of tokens
that the byte adds (or takes back, where a merge closes), so the sum along a
word is its token count.

The second transducer rests on a property of byte-pair merging: the tokens of a
prefix are the tokens of a shorter prefix plus one last token, and a last token
is right exactly if the merges leave the pair of it and its predecessor apart.
The future depends only on the longest suffix that begins some token and, for
the positions inside that suffix, on their last tokens and relative counts; that
finite tuple is the state.  States are compiled when first reached and kept per
worker process, up to ``MAX_STATES``; then compilation starts afresh, which
changes no result. A long word is read in runs, cut where two bytes stand side by side
in no token, which no merge can cross.

Words are told apart by 128 bits of fingerprint.

Defined results: null text is the empty text (0 tokens); special strings inside
texts count one token each; repeated rows are counted each; a null id stays null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretoken
from .bpe_files import default_path, read_json
from .common import arrow_conf, id_text

MAX_STATES = 150_000
MAX_WORDS = 400_000
BATCH_CHARS = 1_000_000
LONG_WORD = 64  # bytes; longer words are cut into runs first


class MergeTransducer:
    """Bytes of one word -> number of tokens, compiled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.starts = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside = pretoken.byte_pairs(ranks)
        self.reset()

    def reset(self) -> None:
        self.apart: dict[int, bool] = {}
        self.edges: dict[tuple[bytes, int], tuple] = {}
        # state: (suffix that begins a token, last tokens, counts relative to now)
        self.states = [(b"", (-1,), (0,))]
        self.index = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.halves:
            parts = [bytes((b,)) for b in self.bytes_of[token]]
            while len(parts) > 2:
                _, at = min((self.ranks.get(a + b, 1 << 60), i)
                            for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None)
        return self.halves[token]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again.

        Undo the merges next to the border from the last one back: the border
        gives way if a merge across it comes before the merge undone last.
        """
        limit, a, b = 1 << 60, left, right
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < limit:
                return False
            sa, sb = self.split(a), self.split(b)
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and a > b):
                limit, a = a, sa[1]
            else:
                limit, b = b + 1, sb[0]

    def edge(self, suffix: bytes, byte: int) -> tuple[bytes, int, tuple]:
        """The suffix after one more byte, how much of it is forgotten, and the
        tokens that can end here, longest first, as (start, token)."""
        found = self.edges.get((suffix, byte))
        if found is None:
            grown = suffix + bytes((byte,))
            cut = 0
            while cut < len(grown) and grown[cut:] not in self.starts:
                cut += 1
            ends = tuple((i, self.ranks[grown[i:]]) for i in range(len(grown)) if grown[i:] in self.ranks)
            found = self.edges[suffix, byte] = grown[cut:], cut, ends
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, lasts, counts = self.states[state]
        grown, cut, ends = self.edge(suffix, byte)
        for start, token in ends:
            before = lasts[start]
            if before < 0:
                break
            pair = before << 20 | token
            fits = self.apart.get(pair)
            if fits is None:
                fits = self.apart[pair] = self.stays_apart(before, token)
            if fits:
                break
        added = counts[start] + 1  # relative to the count before this byte
        key = (grown, (*lasts[cut:], token), (*[c - added for c in counts[cut:]], 0))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = to, added
        return to, added

    def count(self, word: bytes) -> int:
        """Tokens of a word: of its runs, which no token crosses, one after the other."""
        return sum(map(self.run, pretoken.runs(word, self.beside) if len(word) > LONG_WORD else [word]))

    def run(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state = total = 0
        steps = self.steps
        for byte in word:
            step = steps.get(state << 8 | byte)
            state, added = step if step is not None else self.compile(state, byte)
            total += added
        return total


@lru_cache(maxsize=2)
def transducer(tokenizer: str) -> tuple[MergeTransducer, pretoken.WordStore, tuple[str, ...]]:
    """The compiled tokenizer of this worker, counts by word, and special strings."""
    ranks, special = read_json(tokenizer)
    return MergeTransducer(ranks), pretoken.WordStore(MAX_WORDS), tuple(special)


def count_tokens(texts: list[str], tokenizer: str) -> np.ndarray:
    machine, known, special = transducer(tokenizer)
    extra = np.zeros(len(texts), np.int64)
    parts, owner = texts, None
    if special and any(m in t for m in special for t in texts):
        import regex
        mark = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        split = [mark.split(t) for t in texts]
        extra = np.array([len(s) - 1 for s in split])
        parts = [p for s in split for p in s]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    starts, ends, doc, prints, checks = pretoken.words(parts)
    joined = "\0".join(parts)  # one separator where the layout has its sentinel
    sizes, where = known.values(prints, checks, lambda at: [
        machine.count(joined[starts[i]:ends[i]].encode("utf-8", "surrogatepass")) for i in at])
    per_word = np.array(sizes, np.int64)[where] if sizes else np.zeros(0, np.int64)
    if owner is not None:
        doc = owner[doc]
    return extra + np.bincount(doc, weights=per_word, minlength=len(texts)).astype(np.int64)


def batches_of(texts: list[str], limit: int = BATCH_CHARS):
    """Ranges of texts of about ``limit`` characters; a text is never cut."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    arrow_conf(docs.sparkSession)
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")

    def count(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            for lo, hi in batches_of(texts):
                n[lo:hi] = count_tokens(texts[lo:hi], tokenizer)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
