"""FM-index over word sequences: suffix order, wavelet matrix, matching statistics."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]
                                     ).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in positions 0..i-1."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part).astype(np.int64)


class WaveletMatrix:
    """Rank of a symbol in a prefix, one bit vector per binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.digits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[BitRank, int]] = []
        seq = symbols
        for d in range(self.digits - 1, -1, -1):
            bits = (seq >> d & 1).astype(np.bool_)
            self.levels.append((BitRank(bits), int(len(bits) - bits.sum())))
            seq = np.concatenate([seq[~bits], seq[bits]])
        every = np.arange(sigma)
        self.first = self._follow(every, np.zeros(sigma, np.int64))

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d, (bits, zeros) in zip(range(self.digits - 1, -1, -1), self.levels):
            ones = bits.ones(i)
            i = np.where(symbol >> d & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._follow(symbol, i) - self.first[symbol]


def suffix_order(codes: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by prefix doubling; separators are distinct, so suffixes differ
    within ``longest`` symbols."""
    rank, width = codes.astype(np.int64), 1
    n = len(codes)
    while True:
        after = np.full(n, -1, np.int64)
        if width < n:
            after[:-width] = rank[width:]
        key = rank * (n + 1 + int(codes.max(initial=0))) + after + 1 if width == 1 else rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if width > longest or fresh[-1] == n - 1:
            return order


class SegmentIndex:
    """Index of word segments, each with an owner; finds for every segment the
    intervals that also occur in a segment of a smaller owner."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray):
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        words = np.concatenate(segments)
        kinds, dense = np.unique(words, return_inverse=True)
        self.sizes, count = sizes, len(segments)
        starts = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + count
        codes = np.empty(n, np.int64)
        at_end = starts + sizes
        inside = np.ones(n, np.bool_)
        inside[at_end] = False
        codes[at_end] = np.arange(count)       # separators: distinct, below all words
        codes[inside] = dense + count
        self.starts = starts
        self.codes = np.zeros(n, np.int64)     # 0 for any separator, words from 1
        self.codes[inside] = dense + 1
        order = suffix_order(codes, int(sizes.max()) + 1)
        self.n, sigma = n, len(kinds) + 1
        self.bwt = WaveletMatrix(self.codes[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=sigma))])
        _, rank = np.unique(owners, return_inverse=True)
        self.owner = rank.astype(np.int32)
        # least owner over any stretch of the suffix order, by doubling
        level = np.repeat(self.owner, sizes + 1)[order]
        self.least = [level]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            level = np.minimum(level[:-half], level[half:])
            self.least.append(level)

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int32)
        for d in np.unique(k).tolist():
            at = np.flatnonzero(k == d)
            row = self.least[d]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << d)])
        return out

    def covered(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first, last) of maximal stretches of at least ``window`` words
        that a smaller owner has too; stretches of a segment may overlap.

        All segments search in step.  From an end the match grows to the left,
        one backward step at a time, while a smaller owner still has it.  Where it
        stops, the next end is the last one that a window starting there allows.
        """
        seg = np.flatnonzero(self.sizes >= window)
        end = self.sizes[seg] - 1
        pos = end.copy()
        lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), self.n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seg):
            c = self.codes[self.starts[seg] + pos]
            base = self.before[c]
            new_lo, new_hi = base + self.bwt.rank(c, lo), base + self.bwt.rank(c, hi)
            good = new_lo < new_hi
            at = np.flatnonzero(good)
            good[at] = self.least_owner(new_lo[at], new_hi[at]) < self.owner[seg[at]]
            lo, hi = new_lo, new_hi
            pos = np.where(good, pos - 1, pos)
            stop = ~good | (pos < 0)
            if stop.any():
                at = np.flatnonzero(stop)
                long = at[end[at] - pos[at] >= window]
                found.append((seg[long], pos[long] + 1, end[long]))
                end[at] = np.minimum(end[at] - 1, pos[at] + window - 1)
                pos[at], lo[at], hi[at] = end[at], 0, self.n
                stay = ~stop | (end >= window - 1)
                seg, end, pos, lo, hi = (x[stay] for x in (seg, end, pos, lo, hi))
        cols = list(zip(*found)) or [[np.zeros(0, np.int64)]] * 3
        return tuple(np.concatenate(x) for x in cols)
