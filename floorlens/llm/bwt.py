"""Burrows-Wheeler transform of a set of strings, and the common prefixes of
their suffixes by threshold-bounded interval expansion.

The suffixes are sorted by prefix doubling. Common prefix lengths then come
out by increasing value: the interval of every single symbol is extended
backwards, breadth first, one symbol a level. An interval whose right end has
no length yet gives it the level's and goes on; one whose end is known stops
there. Expansion stops at the minimum length, so boundaries without a length
lie between suffixes that share at least that many symbols.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 512
PACKED = 7  # symbols of 9 bits in the first sort key


def suffix_order(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in suffix order, by their first ``depth`` symbols at
    least. Symbol 0 ends a string, and ``end`` has the place of each symbol's
    own end. Ends sort first and differ from each other."""
    n = len(text)
    places = np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(PACKED):
        key = key << 9 | text[np.minimum(places + i, end)]
    stops = np.flatnonzero(text == 0)
    order = np.argsort(key)
    done, rank = PACKED, np.empty(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    while True:
        rank[order] = np.cumsum(fresh)
        rank += len(stops)
        rank[stops] = np.arange(len(stops))
        if done >= depth or fresh.all():
            return np.concatenate((stops, order[text[order] != 0]))
        key = rank * (2 * n + 1) + rank[np.minimum(places + done, end)]
        order = np.argsort(key)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        done *= 2


def common_prefix_classes(symbols: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, string, offset) of every place with ``least`` symbols or more
    after it: places are in one class exactly if they begin with the same
    ``least`` symbols. ``symbols``: all strings one after another, values 1 to
    511; ``size``: their lengths. Rows come class by class."""
    total = int((size + 1).sum())
    starts = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(size)), size + 1)
    end = (starts + size)[owner]
    text = np.zeros(total, np.int64)
    text[np.arange(total) != end] = symbols
    order = suffix_order(text, end, least)

    before = np.where(order == starts[owner[order]], 0, text[order - 1])  # the transform; 0: a string begins
    real = np.argsort(before, kind="stable")
    real = real[before[real] > 0]
    first_of = np.searchsorted(text[order], np.arange(SYMBOLS + 1))
    back = np.full(total, -1)
    group = np.searchsorted(before[real], before[real])
    back[real] = first_of[before[real]] + np.arange(len(real)) - group
    previous, following = np.full(total, -1), np.full(total, total)
    same = before[real[1:]] == before[real[:-1]]
    previous[real[1:][same]] = real[:-1][same]
    following[real[:-1][same]] = real[1:][same]

    known = np.zeros(total + 1, bool)  # boundaries with a common prefix below ``least``
    low = np.flatnonzero(np.diff(first_of[1:])) + 1
    low, high = first_of[low], first_of[low + 1]
    for level in range(least):
        if level:
            width = high - low
            rows = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - low, width)
            reach = back[rows] >= 0
            opens = reach & (previous[rows] < np.repeat(low, width))
            closes = reach & (following[rows] >= np.repeat(high, width))
            low, high = np.sort(back[rows[opens]]), np.sort(back[rows[closes]]) + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        if not len(low):
            break
    short = end[order] - order < least
    known[:-1] |= short
    known[1:] |= short
    known[0] = True
    keep = ~short
    return np.cumsum(known[:-1])[keep], owner[order][keep], (order - starts[owner[order]])[keep]
