"""Benchmark decontamination by a generalised suffix automaton.

Test items become sequences of word ids; one automaton holds all of their
word runs. A document's words stream through it, and the longest match that
ends at each word tells which words lie in a window of item words. Words that
no item has, and neighbours that no item has side by side, reset the match;
such stretches are passed over in numpy before the automaton runs.

The automaton is built on the driver from a block of items of bounded size
(``BLOCK_BYTES``); more items make more blocks, each one more pass over the
documents inside the same stage, so nothing grows with the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import add_columns, raw
from .words import ALNUM, Words

BLOCK_BYTES = 1 << 19


class Automaton:
    """States hold ``next``, ``link`` and ``length``; ``items`` names the test
    items that hold a state's words; ``short`` whole items below the window."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.window = window
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        w = Words(data, np.cumsum([0, *(len(t) for _, t in items)]), ALNUM)
        self.known = np.unique(w.hash)
        ids = np.searchsorted(self.known, w.hash)
        beside = w.row[1:] == w.row[:-1]
        self.pairs = np.unique((ids[:-1] * len(self.known) + ids[1:])[beside])
        self.next, self.link, self.length, self.items, self.short = [{}], [-1], [0], [set()], [[]]
        runs = [(key, ids[a:b].tolist()) for (key, _), a, b in zip(items, w.bounds[:-1], w.bounds[1:], strict=True)]
        runs = [(key, run) for key, run in runs if run]
        self.least = min((min(len(run), window) for _, run in runs), default=window)
        for _, run in runs:
            last = 0
            for word in run:
                last = self._extend(last, word)
        for key, run in runs:
            state = 0
            for word in run:
                state = self.next[state][word]
                up = state
                while up > 0 and len(run) >= window and key not in self.items[up]:
                    self.items[up].add(key)
                    up = self.link[up]
            if len(run) < window:
                self.short[state].append((len(run), key))
        self.any_short = [bool(s) for s in self.short]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.any_short[state] |= self.any_short[self.link[state]]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.short.append([])
        return len(self.link) - 1

    def _split(self, parent: int, word: int, old: int) -> int:
        copy = self._state(self.length[parent] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        old = self.next[last].get(word)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        state, parent = self._state(self.length[last] + 1, {}, 0), last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = state
            parent = self.link[parent]
        if parent >= 0:
            old = self.next[parent][word]
            right = self.length[old] == self.length[parent] + 1
            self.link[state] = old if right else self._split(parent, word, old)
        return state

    def stretches(self, w: Words) -> list[tuple[int, int]]:
        """Runs of words in which each neighbour pair occurs in some item;
        only runs as long as the shortest window can hold one."""
        if not len(w) or not len(self.known):
            return []
        ids = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
        fits = self.known[ids] == w.hash
        both = np.flatnonzero(fits[1:] & fits[:-1] & (w.row[1:] == w.row[:-1]))
        tied = np.zeros(len(w), bool)
        if len(self.pairs):
            pair = ids[both] * len(self.known) + ids[both + 1]
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
            tied[both[found] + 1] = True
        self.ids = np.where(fits, ids, -1)
        first = np.flatnonzero(fits & ~tied)
        last = np.flatnonzero(fits & ~np.append(tied[1:], False)) + 1
        long = last - first >= self.least
        return list(zip(first[long].tolist(), last[long].tolist(), strict=True))

    def stream(self, first: int, last: int):
        """(word, length of the window's match that ends there, item keys)."""
        step, link, length = self.next, self.link, self.length
        state, matched = 0, 0
        for at, word in enumerate(self.ids[first:last].tolist(), first):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state, matched = step[state][word], matched + 1
            if matched >= self.window:
                up = state
                while length[link[up]] >= self.window:
                    up = link[up]
                yield at, matched, self.items[up]
            up = state
            while self.any_short[up]:
                for n, key in self.short[up]:
                    if n <= matched:
                        yield at, n, (key,)
                up = link[up]


def blocks(items: DataFrame, key: str, text: str):
    """Items in blocks of about ``BLOCK_BYTES``: each is gathered alone."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64(key, text), F.lit(n))
    for i in range(n):
        rows = items.where(part == i).where(F.octet_length(text) > 0).select(F.col(key).cast("long"), text).collect()
        yield [(k, t.encode()) for k, t in rows]


def mark(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Adds to each document ``n_words``, ``n_hit`` (words inside any window),
    ``hit_items`` (item ids, ascending) and ``hit_bytes`` (packed pairs of
    byte bounds of the hit runs).

    A window is ``window`` consecutive words of an item; an item of fewer
    words is one window; an item without words is none. Null and empty texts
    have no words. Items of the same id count once, items with a null id hit
    words but are not listed; repeated documents each keep their row; columns
    named like the new ones are replaced."""
    names = ["n_words", "n_hit", "hit_items", "hit_bytes", "_hit_words"]
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.LongType())), T.StructField("hit_bytes", T.BinaryType()),
        T.StructField("_hit_words", T.BinaryType()),
    ]
    out = docs.drop(*names)
    for block in blocks(items, item_key, item_text):
        given = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        again = "_hit_words" in out.columns

        def make(given=given, again=again):
            def work(part):
                machine = given.value
                data, offsets = raw(part.column(text))
                w = Words(data, offsets, ALNUM)
                hit = np.zeros(len(w) + 1, np.int64)
                found = [set() for _ in range(part.num_rows)]
                if again:
                    for row, (old, keys) in enumerate(zip(part.column("_hit_words"), part.column("hit_items"), strict=True)):
                        for a, b in np.frombuffer(old.as_py(), np.int64).reshape(-1, 2) + w.bounds[row]:
                            hit[a] += 1
                            hit[b] -= 1
                        found[row].update(keys.as_py())
                for first, last in machine.stretches(w):
                    keys = found[w.row[first]]
                    for at, n, those in machine.stream(first, last):
                        hit[at + 1 - n] += 1
                        hit[at + 1] -= 1
                        keys.update(those)
                inside = np.cumsum(hit[:-1]) > 0
                n_hit = np.concatenate(([0], np.cumsum(inside)))[w.bounds]
                begins = inside & ~np.concatenate(([False], inside[:-1]))[: len(inside)]
                same = w.row[1:] == w.row[:-1]
                begins[1:] |= inside[1:] & ~same
                ends = inside.copy()
                ends[:-1] &= ~(inside[1:] & same)
                begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
                places = np.searchsorted(begins, w.bounds)
                spans, runs = [], []
                for row in range(part.num_rows):
                    a, b = begins[places[row] : places[row + 1]], ends[places[row] : places[row + 1]]
                    spans.append((np.stack((w.first[a], w.last[b]), 1) - offsets[row]).astype(np.int64).tobytes())
                    runs.append((np.stack((a, b + 1), 1) - w.bounds[row]).astype(np.int64).tobytes())
                return [
                    pa.array(np.diff(w.bounds), pa.int64()), pa.array(np.diff(n_hit), pa.int64()),
                    pa.array([sorted(k for k in keys if k is not None) for keys in found], pa.list_(pa.int64())),
                    pa.array(spans, pa.binary()), pa.array(runs, pa.binary()),
                ]

            return work

        out = add_columns(out, text, fields, make)
    return out.drop("_hit_words")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, most_covered: float = 0.5, **names) -> DataFrame:
    """Documents without the benchmark's words: hit runs are cut out of the
    text, and a document of which more than ``most_covered`` of the words are
    hit goes. All others keep their text to the byte; null stays null."""
    marked = mark(docs, items, window, **names)
    text = names.get("text", "text")

    def make():
        def work(part):
            texts = []
            for value, spans in zip(part.column(text), part.column("hit_bytes"), strict=True):
                value, spans = value.as_py(), np.frombuffer(spans.as_py(), np.int64).reshape(-1, 2)
                if len(spans):
                    data, at, kept = value.encode(), 0, []
                    for a, b in spans.tolist():
                        kept.append(data[at:a])
                        at = b
                    value = b"".join([*kept, data[at:]]).decode()
                texts.append(value)
            return [pa.array(texts, pa.string())]

        return work

    kept = marked.where(F.col("n_hit") <= F.lit(most_covered) * F.col("n_words"))
    cut = add_columns(kept, text, [T.StructField("_clean", T.StringType())], make)
    return cut.withColumn(text, F.col("_clean")).select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: words, hit words, and the items that occur."""
    marked = mark(docs.select(key, "text"), items.select("item_id", "text"))
    listed = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return marked.select(
        key, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
