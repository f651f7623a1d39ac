"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's new words lie end to end in one flat numpy array of symbols.  Every
round takes the segmented minimum pair rank of each word, merges that pair's
occurrences from the left, and compacts the arrays; words without a pair leave,
and the rounds end when none is left.

One merge at a time is the library's rule: best score first, leftmost of equal
ones.  A round takes several of a word only while that comes to the same: it
stops behind the first merge that opens a pair of the same or a better rank
than its own, since the rule would go there next.  Words are cut wherever two
neighbouring characters stand in no piece together (before a space mark, for one),
which no merge can cross, so long texts without spaces fall apart as well.

Encoded words stay in the worker for later batches, by the word itself, up to
``MAX_WORDS`` short ones; then the store starts afresh, which changes no result.

For BPE models with the identity normaliser and a leading space mark; another
model is an error.  A character that is no piece is spelt by its byte pieces.

Defined results: null text is the empty text (the end id alone); marker strings
such as ``</s>`` are ordinary text; repeated rows are encoded each; a null id
stays null; a text of any length is one row of arrays as long as the text.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_files import default_path
from .common import arrow_conf, id_text
from .token_counts import batches_of

MAX_WORDS = 500_000
MAX_WORD_CHARS = 64     # longer words are encoded each time they come
BATCH_CHARS = 1_000_000
MARK = "▁"
NONE = np.int64(2 ** 40)  # rank of a pair that is no piece

codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


class Pieces:
    """Vocabulary as arrays: symbols are pieces (by id), characters that only occur
    inside pieces, and one stranger per other character."""

    def __init__(self, model_path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if lib.normalize("ﬁ  x ") != f"{MARK}ﬁ{MARK}{MARK}x{MARK}":
            raise ValueError(f"{model_path}: only identity normalisation with a leading space mark")
        size = lib.vocab_size()
        every = range(size)
        self.text = [lib.id_to_piece(i) for i in every]
        self.silent = np.array([lib.is_control(i) for i in every])
        self.unknown = lib.unk_id()
        self.byte = np.array([int(self.text[i][3:5], 16) if lib.is_byte(i) else -1 for i in every])
        self.end = lib.eos_id()
        self.names = [str(i) for i in every]
        # what a piece that is no byte adds to a text
        self.plain = ["" if self.silent[i] else " ⁇ " if i == self.unknown else t.replace(MARK, " ")
                      for i, t in enumerate(self.text)]
        # every id from here on is an ordinary piece
        self.beyond = 1 + max(i for i in every if self.byte[i] >= 0 or self.silent[i] or i == self.unknown)
        self.byte_id = {int(b): i for i, b in enumerate(self.byte) if b >= 0}
        if len(self.byte_id) != 256:
            raise ValueError(f"{model_path}: no byte pieces")
        normal = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError(f"{model_path}: unused pieces")
        symbol = {self.text[i]: i for i in normal}
        for ch in sorted(set("".join(symbol)) - set(symbol)):
            symbol[ch] = size + len(symbol) - len(normal)
        self.stranger = size + len(symbol) - len(normal)
        self.width = np.int64(self.stranger + 1)

        order = np.unique([-lib.get_score(i) for i in normal], return_inverse=True)[1]
        rank = dict(zip(normal, order.tolist()))
        keys, ranks, made, beside = [], [], [], set()
        for i in normal:
            t = self.text[i]
            beside.update(zip(t, t[1:]))
            for k in range(1, len(t)):
                a, b = symbol.get(t[:k]), symbol.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    ranks.append(rank[i])
                    made.append(i)
        by_key = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[by_key]
        self.ranks = np.array(ranks, np.int64)[by_key]
        self.made = np.array(made, np.int64)[by_key]
        self.char = np.full(0x110000, self.stranger, np.int64)
        for ch, s in symbol.items():
            if len(ch) == 1:
                self.char[ord(ch)] = s
        self.beside = np.unique([self.char[ord(a)] * self.width + self.char[ord(b)] for a, b in beside])
        # white space and digits that stand beside nothing in any piece are cut off as well
        near = set(np.concatenate([self.beside // self.width, self.beside % self.width]).tolist())
        alone = "".join(c for c in "\n\r\t0123456789" if self.char[ord(c)] not in near)
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]{{1,3}}" if alone else ""))
        self.known: dict[str, tuple[int, str, str]] = {}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair (NONE where it is no piece)."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], 0)


@lru_cache(maxsize=2)
def pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def merge_rounds(p: Pieces, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and the word each belongs to (ascending) -> the word, symbol and
    first code point of every symbol left when no pair remains."""
    sym = p.char[codes]
    # runs: words, cut where two neighbours are in no piece together
    near = sym[:-1] * p.width + sym[1:]
    at = np.minimum(np.searchsorted(p.beside, near), len(p.beside) - 1)
    cut = (word[1:] != word[:-1]) | (p.beside[at] != near)
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(cut)])
    place = np.arange(len(sym))
    rank = np.full(len(sym), NONE)     # of the pair that starts here
    made = np.zeros(len(sym), np.int64)
    inner = np.flatnonzero(~cut)
    rank[inner], made[inner] = p.pair(sym[inner], sym[inner + 1])
    done = []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        live = least < NONE
        if not live.all():
            rest = np.repeat(live, sizes)
            done.append((place[~rest], sym[~rest]))
            sym, run, place, rank, made = (x[rest] for x in (sym, run, place, rank, made))
            least, sizes = least[live], sizes[live]
            if not len(sym):
                break
        low = np.repeat(least, sizes)
        # occurrences of the least pair that do not overlap, from the left
        hit = np.flatnonzero(rank == low)
        fresh = np.concatenate([[True], np.diff(hit) != 1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
        # the pairs a merge opens, when those before it in the word are done
        new, mine = made[hit], low[hit]
        left = np.maximum(hit - 1, 0)
        before = sym[left]
        follows = np.concatenate([[False], np.diff(hit) == 2])
        before = np.where(follows, np.concatenate([new[:1], new[:-1]]), before)
        has_left = (hit > 0) & (run[left] == run[hit])
        right = np.minimum(hit + 2, len(sym) - 1)
        has_right = (hit + 2 < len(sym)) & (run[right] == run[hit])
        opened = np.minimum(np.where(has_left, p.pair(before, new)[0], NONE),
                            np.where(has_right, p.pair(new, sym[right])[0], NONE))
        stop = (opened <= mine).astype(np.int64)
        earlier = np.cumsum(stop) - stop
        of = run[hit]
        first = np.concatenate([[True], of[1:] != of[:-1]])
        base = earlier[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
        take = earlier == base
        hit, new = hit[take], new[take]
        # merge and compact
        sym[hit] = new
        rest = np.ones(len(sym), bool)
        rest[hit + 1] = False
        to = np.cumsum(rest) - 1
        sym, run, place, rank, made = (x[rest] for x in (sym, run, place, rank, made))
        at = to[hit]
        marked = np.zeros(len(sym), bool)
        marked[at] = True
        marked[at[at > 0] - 1] = True
        touched = np.flatnonzero(marked)
        inside = np.zeros(len(touched), bool)
        ok = touched + 1 < len(sym)
        inside[ok] = run[touched[ok]] == run[touched[ok] + 1]
        rank[touched] = NONE
        touched = touched[inside]
        rank[touched], made[touched] = p.pair(sym[touched], sym[touched + 1])
    place = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
    sym = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(place)
    place, sym = place[order], sym[order]
    return word[place], sym, place


def encode_words(p: Pieces, words: list[str]) -> list[list[int]]:
    """Ids of each word, without any end id."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of, sym, place = merge_rounds(p, codes, np.repeat(np.arange(len(words)), sizes))
    cuts = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
    ids = sym.tolist()
    if (sym >= len(p.text)).any():  # characters that are no piece, by their bytes
        spelt = [[p.byte_id[b] for b in chr(codes[at]).encode("utf-8", "surrogatepass")]
                 if s >= len(p.text) else [s] for s, at in zip(ids, place.tolist())]
        return [[i for x in spelt[a:b] for i in x] for a, b in zip(cuts, cuts[1:])]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_ids(p: Pieces, ids: list[int], start: bool = True) -> str:
    """Text of ids: markers are silent, bytes are read as UTF-8 (one replacement
    character for each byte that is not), the first space mark of a text goes."""
    out: list[str] = []
    raw = bytearray()
    seen = not start
    for i in ids:
        if p.byte[i] >= 0:
            raw.append(int(p.byte[i]))
            continue
        if raw:
            out.append(raw.decode("utf-8", "each-byte"))
            raw, seen = bytearray(), True
        if p.silent[i]:
            continue
        out.append(p.plain[i] if seen or i == p.unknown else p.plain[i].removeprefix(" "))
        seen = True
    if raw:
        out.append(raw.decode("utf-8", "each-byte"))
    return "".join(out)


def encode_texts(texts: list[str], model_path: str) -> list[list[tuple[int, str, str]]]:
    """Per text its words, each as (number of ids, ids joined by spaces, decoded
    text with the leading space mark as a space)."""
    p = pieces(model_path)
    split = [p.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    known = p.known
    if len(known) > MAX_WORDS:
        known.clear()
    fresh = list({w for words in split for w in words if w not in known})
    for lo, hi in batches_of(fresh, BATCH_CHARS):
        for w, ids in zip(fresh[lo:hi], encode_words(p, fresh[lo:hi])):
            known[w] = (len(ids), " ".join([p.names[i] for i in ids]),
                        "".join([p.plain[i] for i in ids]) if min(ids) >= p.beyond
                        else decode_ids(p, ids, start=False))
    out = [[known[w] for w in words] for words in split]
    for w in fresh:
        if len(w) > MAX_WORD_CHARS:
            del known[w]
    return out


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (array<int>, the end id last), decoded (string); with ``digests``
    the count and SHA-256 of both instead, so that ids need not leave the worker."""
    arrow_conf(docs.sparkSession)
    model = model or default_path("piece_bpe_32k.model")

    def run(batches):
        end = str(pieces(model).end)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            texts = b.column(1).to_pylist()
            counts, ids, bodies = [], [], []
            for lo, hi in batches_of(texts, BATCH_CHARS):
                for words in encode_texts(texts[lo:hi], model):
                    n, parts, text = zip(*words) if words else ((), (), ())
                    counts.append(sum(n) + 1)
                    line = " ".join([*parts, end])
                    body = "".join(text).removeprefix(" ")
                    ids.append(sha(line) if digests else np.array(line.split(), np.int32))
                    bodies.append(sha(body) if digests else body)
            cols = ([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(bodies, pa.string())]
                    if digests else [pa.array(ids, pa.list_(pa.int32())), pa.array(bodies, pa.string())])
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    names, schema = ((["n_tokens", "ids_sha256", "decoded_sha256"],
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string") if digests
                     else (["ids", "decoded"], "doc_id long, ids array<int>, decoded string"))
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: any sequence of ids back to text (null ids: empty text)."""
    from pyspark.sql import functions as F
    arrow_conf(encoded.sparkSession)
    model = model or default_path("piece_bpe_32k.model")

    def run(batches):
        p = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([decode_ids(p, x or []) for x in b.column(1).to_pylist()], pa.string())],
                names=["doc_id", "decoded"])
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")
