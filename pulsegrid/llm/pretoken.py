"""Splitting text into the words of byte-level BPE, as arrays.

A deterministic transducer reads character classes and marks where a word of the
splitting pattern starts.  Texts of a batch are laid end to end and cut into
chunks; every chunk yields its state map (end state for each start state), the
maps are composed by a parallel prefix scan, and with the start state of each
chunk known all chunks emit their marks side by side.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from .wordhash import placed_sums

# symbols: character classes, with the lookahead the pattern needs folded in
L, N, SPACE, WHITE, OTHER, END, APOS1, APOS2, SPACE_LAST, WHITE_LAST = range(10)
# states: what the character just read belongs to
START, IN_L, IN_N, IN_O, IN_WS, LEAD, ONE_MORE, TWO_MORE, DONE = range(9)
SYMBOLS, STATES = 10, 9
CHUNK = 128
END_CODE = 0x110000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point (the sentinel after the last one ends a text)."""
    import regex
    from tokenizers import pre_tokenizers
    points = [*range(0xD800), *range(0xE000, END_CODE)]
    every, codes = "".join(map(chr, points)), np.array(points)
    table = np.full(END_CODE + 1, OTHER, np.uint8)
    older = np.full(END_CODE + 1, OTHER, np.uint8)
    older[codes] = [{"L": L, "N": N}.get(unicodedata.category(c)[0], OTHER) for c in every]
    for cls, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[codes[m.start():m.end()]] = cls
    # characters newer than one of the two Unicode tables: as the tokenizer library has them
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero((table != older) & (table != WHITE)).tolist():
        parts = [end - start for _, (start, end) in cut(f"x{chr(c)}1")]
        table[c] = {(2, 1): L, (1, 2): N}.get(tuple(parts), OTHER)
    table[ord(" ")] = SPACE
    table[END_CODE] = END
    return table


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """next state and start mark, both indexed by symbol * STATES + state."""
    nxt = np.zeros((SYMBOLS, STATES), np.uint8)
    mark = np.ones((SYMBOLS, STATES), np.bool_)

    def rule(symbol, to, stays=()):
        nxt[symbol] = to
        for s in stays:
            mark[symbol, s] = False

    rule(L, IN_L, (IN_L, LEAD))
    rule(N, IN_N, (IN_N, LEAD))
    rule(OTHER, IN_O, (IN_O, LEAD))
    rule(SPACE, IN_WS, (IN_WS,))
    rule(WHITE, IN_WS, (IN_WS,))
    rule(SPACE_LAST, LEAD)          # joins the word that follows
    rule(WHITE_LAST, DONE)          # a word of its own
    rule(END, START)
    for symbol, to in ((APOS1, ONE_MORE), (APOS2, TWO_MORE)):
        rule(symbol, to, (IN_O, LEAD))  # inside a run it is no contraction
        nxt[symbol, [IN_O, LEAD]] = IN_O
    for state, to in ((TWO_MORE, ONE_MORE), (ONE_MORE, DONE)):
        nxt[:, state] = to
        mark[:, state] = False
    return nxt.ravel(), mark.ravel()


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol per code point; ``codes`` must finish with the sentinel."""
    sym = class_table()[codes]
    white = (sym == SPACE) | (sym == WHITE)
    follows = np.empty(len(sym), np.bool_)  # followed by a character that is no white space
    follows[:-1] = ~white[1:] & (sym[1:] != END)
    follows[-1] = False
    at = np.flatnonzero(white & follows)
    sym[at] = np.where(sym[at] == SPACE, SPACE_LAST, WHITE_LAST)
    at = np.flatnonzero(codes == 39)
    if len(at):
        a = codes[np.minimum(at + 1, len(codes) - 1)]
        b = codes[np.minimum(at + 2, len(codes) - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[at] = np.where(one, APOS1, np.where(two, APOS2, OTHER))
    return sym


def word_marks(sym: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Start marks by chunk state maps and a prefix scan over their composition."""
    nxt, mark = transducer()
    k = -(-len(sym) // chunk)
    padded = np.full(k * chunk, END, np.uint8)
    padded[:len(sym)] = sym
    rows = np.ascontiguousarray(padded.reshape(k, chunk).T) * np.uint8(STATES)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (k, 1))
    for row in rows:
        maps = nxt[row[:, None] + maps]
    reach = 1
    while reach < k:  # maps[i] becomes the composition of chunks 0..i
        later = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    state = np.full(k, START, np.uint8)
    state[1:] = maps[:-1, START]
    out = np.empty((chunk, k), np.bool_)
    for i, row in enumerate(rows):
        at = row + state
        out[i] = mark[at]
        state = nxt[at]
    return out.T.ravel()[:len(sym)]


def lay_out(texts: list[str]) -> np.ndarray:
    """Code points of all texts, each text followed by the sentinel."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.empty(int(sizes.sum()) + len(texts), np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(len(codes), np.bool_)
    body[ends] = False
    codes[ends] = END_CODE
    codes[body] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end (code points over the laid-out texts), text number and
    fingerprint (two times 64 bits) of every word, in order."""
    codes = lay_out(texts)
    sym = symbols(codes)
    starts = np.flatnonzero(word_marks(sym))
    ends = np.append(starts[1:], len(codes))
    real = sym[starts] != END
    doc = np.cumsum(sym[starts] == END)
    prints, checks = (placed_sums(codes, ends - starts, seed)[real] for seed in (1, 2))
    return starts[real], ends[real], doc[real], prints, checks


class WordStore:
    """What is known of words, by their fingerprints: looked up by the first half, and
    taken only if the second agrees."""

    def __init__(self, most: int):
        self.most = most
        self.held: dict = {}

    def values(self, prints: np.ndarray, checks: np.ndarray, make) -> tuple[list, np.ndarray]:
        """Values of the different words, and which of them every word has; ``make`` gives
        those of words not known yet from the places where they first stand."""
        _, first, where = np.unique(prints, return_index=True, return_inverse=True)
        if (checks[first][where] != checks).any():  # the first halves do not suffice
            both = np.stack([prints, checks], axis=1)
            _, first, where = np.unique(both, axis=0, return_index=True, return_inverse=True)
            where = where.ravel()
        if len(self.held) > self.most:
            self.held.clear()
        keys, second = prints[first].tolist(), checks[first].tolist()
        got = [self.held.get(k) for k in keys]
        missing = [i for i, (g, c) in enumerate(zip(got, second)) if g is None or g[0] != c]
        if missing:
            for i, value in zip(missing, make(first[missing].tolist())):
                got[i] = self.held[keys[i]] = (second[i], value)
        return [g[1] for g in got], where


def byte_pairs(tokens) -> np.ndarray:
    """[a, b]: whether byte b follows byte a inside some token."""
    beside = np.zeros((256, 256), bool)
    for t in tokens:
        x = np.frombuffer(t, np.uint8)
        beside[x[:-1], x[1:]] = True
    return beside


def runs(word: bytes, beside: np.ndarray) -> list[bytes]:
    """The word cut between bytes that no token holds together: no merge crosses a cut."""
    x = np.frombuffer(word, np.uint8)
    cuts = [0, *(np.flatnonzero(~beside[x[:-1], x[1:]]) + 1).tolist(), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]
