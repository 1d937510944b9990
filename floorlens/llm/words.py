"""Words of many texts at once: bounds, rows and 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(np.uint64)

_powers: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def forget() -> None:
    """Frees the tables of powers."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """``first``, ``last``: byte bounds in ``data`` (lower-cased); ``row``: the
    text of each word; ``hash``: equal for equal words; ``bounds``: the n + 1
    places where the words of each text begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        self.data = LOWER[data]
        inside = letters[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.first = np.flatnonzero(inside & (~before | edge[:-1]))
        self.last = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.first, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[self.data] * powers(BASE, len(data)), out=total[1:])
        value = (total[self.last] - total[self.first]) * powers(UNBASE, len(data) + 1)[self.first]
        self.hash = mix(value + (self.last - self.first).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.first)
