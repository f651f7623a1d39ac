"""Fingerprints of white-space separated words, for whole batches of texts."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def placed_sums(symbols: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit sum per word over words laid end to end: every symbol counts with a
    value drawn for it and its place in the word, so no arithmetic between places
    (as in a polynomial) lets different words meet."""
    ends = np.cumsum(sizes)
    drawn = np.arange(len(symbols), dtype=np.uint64)
    drawn -= np.repeat((ends - sizes).astype(np.uint64), sizes)  # place in the word
    with np.errstate(over="ignore"):
        drawn <<= np.uint64(21)
        drawn += symbols
        drawn += np.uint64(seed * 0x9E3779B97F4A7C15 % 2 ** 64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, None)):
            drawn ^= drawn >> np.uint64(shift)
            if factor:
                drawn *= np.uint64(factor)
        total = np.zeros(len(drawn) + 1, np.uint64)
        np.cumsum(drawn, out=total[1:])
        return total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, cuts): the words of body i are cuts[i]:cuts[i+1]."""
    data = np.frombuffer(b"".join(x for b in bodies for x in (b, b"\n")), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bodies) + 1, np.int64)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]  # the last byte is a space, so edges pair up
    raw = placed_sums(data[inside], ends - starts)
    bounds = np.cumsum([0, *[len(b) + 1 for b in bodies]])
    return mixed(raw), np.searchsorted(starts, bounds)
