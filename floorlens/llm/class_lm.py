"""Language-model scores by a class-based bigram model.

Every training word gets a class by exchange: words move between classes as
long as the likelihood of the class bigrams of the training corpus grows.

* The most frequent words and, for all others, groups by their last bytes are
  the units of a first exchange on the driver. It gives a start only.
* The ``NEAR`` most frequent words then move in rounds, each by the counts of
  its own neighbours, until a round adds less than ``LEAST_GAIN`` of the
  likelihood. A table holds one row per word with its neighbours; a round is one
  scan of it, without a shuffle.
* Each other word takes, by its own neighbours, the class that raises the
  likelihood most.

A token's probability is that of its class after the word before it, times that
of the word in its class; both are smoothed. As the word before, a frequent word
stands for its class and any other for its group's: tasks know the first without
a join. Between two words beyond the frequent ones, the class bigram is counted
once both have their classes, not during the rounds.

The driver and the broadcasts hold tables bounded by ``NEAR``, by ``UNITS``
squared and by ``CLASSES`` squared; counts, neighbours and classes of words are
Spark tables that grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import raw, slices
from .tables import stored
from .words import SPACED, Words, mix

UNITS, SUFFIXES, CLASSES, ROUNDS = 2048, 512, 64, 6
NEAR = 1 << 16
LEAST_GAIN = 2e-4
SIDE, TWO = 1 << 20, 1 << 40  # of a neighbour on the right; of a pair of neighbours
STEP = 1 << 16  # neighbours whose gains are held at once
END = np.uint64(1)
ADD = 0.5
PULL = 50.0
HELD = 1 << 20  # distinct words or pairs that a task holds before it sends them


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 5; a null id is not
    held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))


def _tokens(part) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice; then of all tokens, each text's words and one end:
    the text, the hash, and the suffix group (-1: end)."""
    w = Words(*raw(part.column("text")), SPACED)
    n = part.num_rows
    ends = w.bounds[1:] + np.arange(n)
    is_end = np.zeros(len(w) + n, bool)
    is_end[ends] = True
    code, group = np.full(len(is_end), END), np.full(len(is_end), -1)
    code[~is_end] = w.hash
    tail = np.zeros(len(w), np.uint64)
    for i in (1, 2, 3):
        at = np.maximum(w.last - i, 0)
        tail = tail << np.uint64(8) | np.where(w.last - i >= w.first, w.data[at], 0).astype(np.uint64) if len(w) else tail
    group[~is_end] = (mix(tail) % np.uint64(SUFFIXES)).astype(np.int64)
    row = np.empty(len(is_end), np.int64)
    row[~is_end], row[is_end] = w.row, np.arange(n)
    return row, code, group, is_end


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64)


def _gathered(stream, count):
    """Sums ``count(slice) -> (keys, counts)`` over a task, sent in parts."""
    keys, counts, held = [], [], 0
    for batch in stream:
        for part in slices(batch, "text"):
            k, c = count(part)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 2 * HELD:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > HELD:
                    yield k, c
                    keys, counts, held = [], [], 0
    if held:
        yield _summed(keys, counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, suffix, c) of every token of ``docs``; the end has suffix -1."""
    pair = np.dtype([("word", np.uint64), ("suffix", np.int64)])

    def run(stream):
        def count(part):
            _, code, group, _ = _tokens(part)
            order = np.argsort(code)
            code, group = code[order], group[order]
            fresh = np.ones(len(code), bool)
            fresh[1:] = code[1:] != code[:-1]
            fresh = np.flatnonzero(fresh)
            both = np.empty(len(fresh), pair)
            both["word"], both["suffix"] = code[fresh], group[fresh]
            return both, np.diff(fresh, append=len(code))

        for k, c in _gathered(stream, count):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k["word"].astype(np.int64)), pa.array(k["suffix"].copy()), pa.array(c)], ["word", "suffix", "c"]
            )

    rows = docs.mapInArrow(run, "word long, suffix long, c long")
    return rows.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c"))


class Near:
    """Frequent words by hash: their counts and units; other words' units."""

    def __init__(self, word: np.ndarray, suffix: np.ndarray, count: np.ndarray):
        """Words by falling count; the end, if any, is first."""
        own = np.arange(len(word)) < UNITS - SUFFIXES
        unit = np.where(own, SUFFIXES + np.arange(len(word)), suffix)
        order = np.argsort(word.view(np.uint64))
        self.code, self.count = word.view(np.uint64)[order], count[order]
        self.suffix, self.unit = suffix[order], unit[order]

    def find(self, code: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens in the table (-1: none), and their places as
        neighbours: beyond the table come the suffix groups. An end that was
        never counted shares group 0."""
        far = len(self.code) + np.maximum(group, 0)
        if not len(self.code):
            return np.full(len(code), -1), far
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        at = np.where(self.code[at] == code, at, -1)
        return at, np.where(at >= 0, at, far)

    def units(self) -> np.ndarray:
        """The unit of each neighbour."""
        return np.concatenate((self.unit, np.arange(SUFFIXES)))


def neighbours(docs: DataFrame, near) -> DataFrame:
    """(word, at, met): each word with its place among the frequent ones (-1:
    none) and its neighbours as 64-bit values: the place of the neighbour,
    ``SIDE`` if it stands to the right, and the count above bit 21. A text
    follows an end. A row has at most ``2 * (NEAR + SUFFIXES)`` neighbours."""

    def count(stream):
        def pairs(part):
            _, code, group, _ = _tokens(part)
            at, place = near.value.find(code, group)
            left = np.concatenate((place[-1:], place[:-1]))  # a slice ends with an end, as every text does
            right = np.concatenate((place[1:], place[:1]))
            seen = at >= 0
            far.append((code[~seen].view(np.int64), TWO | right[~seen] * SIDE | left[~seen]))
            own = at[seen] << 21
            return np.unique(np.concatenate((own | left[seen], own | SIDE | right[seen])), return_counts=True)

        def rows(word, key, c):
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(key), pa.array(c)], ["word", "key", "c"])

        far = []
        for batch in stream:
            for k, c in _gathered(iter([batch]), pairs):
                yield rows(near.value.code.view(np.int64)[k >> 21], k & (2 * SIDE - 1), c)
            for word, key in far:
                yield rows(word, key, np.ones(len(key), np.int64))
            far.clear()

    def group(stream):
        def rows(word, key, c):
            both = key >= TWO
            word = np.concatenate((word[~both], word[both], word[both]))
            met = np.concatenate((key[~both], key[both] & (SIDE - 1), SIDE | (key[both] - TWO) >> 20))
            c = np.concatenate((c[~both], c[both], c[both]))
            order = np.lexsort((met, word))
            word, met, c = word[order], met[order], c[order]
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (met[1:] != met[:-1])
            fresh = np.flatnonzero(fresh)
            return word[fresh], met[fresh], np.add.reduceat(c, fresh)

        def packed(word, met, c):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            data = pa.py_buffer((met | c << 21).tobytes())
            bounds = pa.py_buffer((np.append(first, len(word)) * 8).astype(np.int32).tobytes())
            at, _ = near.value.find(word[first].view(np.uint64), np.zeros(len(first), np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(word[first]), pa.array(at.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, bounds, data])], ["word", "at", "met"]
            )

        held = [np.zeros(0, np.int64)] * 3
        for batch in stream:
            new = [batch.column(i).to_numpy() for i in range(3)]
            if not len(new[0]):
                continue
            word, met, c = rows(*(np.concatenate(x) for x in zip(held, new, strict=True)))
            cut = np.searchsorted(word, word[-1])  # the last word may go on in the next batch
            if cut:
                yield packed(word[:cut], met[:cut], c[:cut])
            held = [word[cut:], met[cut:], c[cut:]]
        if len(held[0]):
            yield packed(*held)

    counted = docs.mapInArrow(count, "word long, key long, c long").repartition("word").sortWithinPartitions("word")
    return counted.mapInArrow(group, "word long, at int, met binary")


def _blocks(stream):
    """Rows of ``neighbours`` with about ``STEP`` neighbours at once: the words,
    their places, and of each neighbour the row, side, place and count."""
    for batch in stream:
        data, offsets = raw(batch.column("met"))
        items, bounds = data.view(np.int64), offsets // 8
        word, at = batch.column("word").to_numpy(), batch.column("at").to_numpy().astype(np.int64)
        start = 0
        while start < len(word):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + STEP, side="right")) - 1)
            x = items[bounds[start] : bounds[stop]]
            row = np.repeat(np.arange(stop - start), np.diff(bounds[start : stop + 1]))
            yield word[start:stop], at[start:stop], row, x >> 20 & 1, x & (SIDE - 1), x >> 21
            start = stop


def _sent(kind: int, table: np.ndarray):
    """The filled places of a table of sums."""
    flat = np.asarray(table).ravel()
    at = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(flat[at].astype(np.int64))], ["kind", "key", "c"])


SENT = "kind long, key long, c long"


def _collected(sent: DataFrame, sizes: dict[int, int]) -> list[np.ndarray]:
    """Summed tables by kind, of the given sizes."""
    rows = sent.groupBy("kind", "key").agg(F.sum("c").alias("c")).toArrow()
    kind, key, c = (rows[x].to_numpy() for x in ("kind", "key", "c"))
    out = []
    for k, n in sizes.items():
        out.append(np.zeros(n, np.int64))
        out[-1][key[kind == k]] = c[kind == k]
    return out


def unit_pairs(met: DataFrame, near) -> np.ndarray:
    """Neighbouring units, of which one at least is a frequent word's."""

    def run(stream):
        unit, n = near.value.units(), len(near.value.code)
        total = np.zeros(UNITS * UNITS, np.int64)
        for _, at, row, side, place, c in _blocks(stream):
            own, other = unit[at][row], unit[place]
            own, other, c = (x[(side == 0) | (place >= n)] for x in (own, np.where(side == 0, other, own) * UNITS + np.where(side == 0, own, other), c))
            np.add.at(total, other, c)
        yield _sent(0, total)

    return _collected(met.mapInArrow(run, SENT), {0: UNITS * UNITS})[0].reshape(UNITS, UNITS)


def _f(x):
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """The class of each unit: every unit in turn, most frequent first, moves
    to the class that raises the log likelihood of class bigrams most; ends
    after a round without a move, or ``rounds``."""

    f = _f
    n = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    joint = np.zeros((classes, n))
    np.add.at(joint, of, pairs)
    table = np.zeros((classes, classes))
    np.add.at(table.T, of, joint.T)
    out, into = table.sum(1), table.sum(0)
    for _ in range(rounds):
        moved = 0
        for u in order:
            own = pairs[u, u]
            right = np.bincount(of, pairs[u], classes)
            left = np.bincount(of, pairs[:, u], classes)
            a = of[u]
            right[a] -= own
            left[a] -= own
            total_right, total_left = right.sum() + own, left.sum() + own
            if not total_right + total_left:
                continue
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            out[a] -= total_right
            into[a] -= total_left
            gain = (f(table + right) - f(table)).sum(1) + (f(table.T + left) - f(table.T)).sum(1)
            d = np.diagonal(table)
            gain += f(d + right + left + own) - f(d + right) - f(d + left) + f(d)
            gain -= f(out + total_right) - f(out) + f(into + total_left) - f(into)
            k = int(np.argmax(gain))
            k = k if gain[k] > gain[a] + 1e-9 else a
            moved += k != a
            of[u] = k
            table[k] += right
            table[:, k] += left
            table[k, k] += own
            out[k] += total_right
            into[k] += total_left
        if not moved:
            break
    return of


def _likelihood(table: np.ndarray) -> float:
    """What of the log likelihood depends on classes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


class Gains:
    """What the likelihood gains if a word with given neighbours enters a class."""

    def __init__(self, table: np.ndarray):
        """``table``: class bigrams, the class before in rows."""
        self.both = np.concatenate((table, table.T)).astype(float)  # by side and class of the neighbour: each class
        self.sums = np.stack((table.sum(0), table.sum(1))).astype(float)  # what stands left of a class's words; right
        self.few = np.stack([_f(self.both + v) - _f(self.both) for v in range(17)])

    def __call__(self, n: int, row: np.ndarray, slot: np.ndarray, v: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """n x classes, for filled slots (side and class of the neighbour) with
        counts ``v``, by row; every row has a slot. ``own``: the classes that
        hold the words already."""
        each = self.few[np.minimum(v, 16), slot]
        many = np.flatnonzero(v > 16)
        each[many] = _f(self.both[slot[many]] + v[many, None]) - _f(self.both[slot[many]])
        begin = np.searchsorted(row, np.arange(n))
        gain = np.add.reduceat(each, begin, axis=0)
        totals = np.stack([np.bincount(row[slot // CLASSES == i], v[slot // CLASSES == i], n) for i in (0, 1)])
        for total, of_class in zip(totals, self.sums, strict=True):
            gain -= _f(of_class + total[:, None]) - _f(of_class)
        if own is not None:
            held = self.both[slot, own[row]]
            stay = np.add.reduceat(_f(held) - _f(np.maximum(held - v, 0)), begin)
            for total, of_class in zip(totals, self.sums, strict=True):
                stay -= _f(of_class[own]) - _f(np.maximum(of_class[own] - total, 0))
            gain[np.arange(n), own] = stay
        return gain


def _slots(row, side, cls, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by row and slot, in order."""
    key, v = _summed([(row * 2 + side) * CLASSES + cls], [c])
    return key // (2 * CLASSES), key % (2 * CLASSES), v


def _round(met: DataFrame, near, of: np.ndarray, table: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One scan of the frequent words: the classes after their moves; under the
    classes before, the bigrams into frequent words and those from them into
    others; what the moves change of both, their neighbours held still. About
    half of the words may move in a turn, drawn by hash: neighbours that all
    moved at once would follow each other in circles."""
    given = met.sparkSession.sparkContext.broadcast((of, Gains(table)))

    def run(stream):
        of, gains = given.value
        n = len(near.value.code)
        free = mix(near.value.code + np.uint64(turn)) & np.uint64(1) == 0
        into, beyond, change = (np.zeros((CLASSES, CLASSES), np.int64) for _ in range(3))
        moved = np.zeros(n, np.int64)
        for _, at, row, side, place, c in _blocks(stream):
            own, cls = of[at], of[place]
            left, out = side == 0, (side == 1) & (place >= n)
            np.add.at(into, (cls[left], own[row[left]]), c[left])
            np.add.at(beyond, (own[row[out]], cls[out]), c[out])
            row, slot, v = _slots(row, side, cls, c)
            gain = gains(len(at), row, slot, v, own)
            best = np.argmax(gain, 1)
            all_rows = np.arange(len(at))
            goes = free[at] & (gain[all_rows, best] > gain[all_rows, own] + 1e-9)
            moved[at[goes]] = best[goes] + 1
            some = goes[row]
            row, slot, v = row[some], slot[some], v[some]
            for cls, sign in ((own, -1), (best, 1)):
                k, other, left = cls[row], slot % CLASSES, slot < CLASSES
                np.add.at(change, (np.where(left, other, k), np.where(left, k, other)), sign * v)
        for kind, x in enumerate((moved, into, beyond, change)):
            yield _sent(kind, x)

    cells = CLASSES * CLASSES
    moved, into, beyond, change = _collected(met.mapInArrow(run, SENT), {0: len(of), 1: cells, 2: cells, 3: cells})
    given.unpersist()
    return (np.where(moved > 0, moved - 1, of), *(x.reshape(CLASSES, CLASSES) for x in (into, beyond, change)))


def frequent_classes(met: DataFrame, near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each neighbour place, the bigrams into frequent words, and
    all bigrams with a frequent word. Rounds go on until one adds less than
    ``LEAST_GAIN`` to the likelihood; one that lowers it is undone."""
    pairs = unit_pairs(met, near)
    of_unit = exchange(pairs.astype(float), CLASSES, ROUNDS)
    of = of_unit[near.value.units()]
    table = np.zeros((CLASSES, CLASSES), np.int64)
    np.add.at(table, (of_unit[:, None], of_unit[None, :]), pairs)
    best = None
    turn = 0
    while True:
        after, into, beyond, change = _round(met, near, of, table, turn)
        table = into + beyond
        now = _likelihood(table)
        if best is not None and now <= best[0]:
            break
        small = best is not None and turn > 1 and now - best[0] < LEAST_GAIN * abs(now)
        best = (now, of, into, table)
        if small or (after == of).all():
            break
        of, table, turn = after, table + change, turn + 1
    return best[1:]


WORD_CLASSES = "kind long, word long, cls long, c long"


def other_classes(met: DataFrame, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """Of each word beyond the frequent ones a row of kind 0 with its class and
    count; of each task rows of kind 1 with the bigrams into them (``word``: the
    class before) and of kind 2 with their number by class."""
    given = met.sparkSession.sparkContext.broadcast((of, Gains(table)))

    def run(stream):
        of, gains = given.value
        names = [x.split()[0] for x in WORD_CLASSES.split(", ")]
        into, members = np.zeros((CLASSES, CLASSES), np.int64), np.zeros(CLASSES, np.int64)
        for word, _, row, side, place, c in _blocks(stream):
            cls = of[place]
            at, slot, v = _slots(row, side, cls, c)
            best = np.argmax(gains(len(word), at, slot, v), 1)
            left = side == 0
            np.add.at(into, (cls[left], best[row[left]]), c[left])
            members += np.bincount(best, minlength=CLASSES)
            count = np.bincount(row[left], c[left], len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(len(word), np.int64), word, best, count)], names)
        before, after = np.nonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ones(len(before), np.int64), before, after, into[before, after])], names)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(CLASSES, 2), np.full(CLASSES, -1), np.arange(CLASSES), members)], names)

    return met.mapInArrow(run, WORD_CLASSES)


class Model:
    """What a task needs to score: bounded by ``NEAR`` and ``CLASSES``."""

    def __init__(self, near: Near, of: np.ndarray, table: np.ndarray, kinds: int, members: np.ndarray):
        """``of``: the class of each place before; ``table``: all bigrams."""
        self.near, self.of = near, of
        mass = table.sum(0)
        self.tokens = int(mass.sum())
        share = (mass + 1) / (mass + 1).sum()
        self.step = np.log10((table + PULL * share) / (table.sum(1, keepdims=True) + PULL))
        self.below = mass + ADD * (members + 1)  # of a word's probability in its class
        self.floor = self.tokens + ADD * (kinds + 1)
        self.word = np.log10((near.count + ADD) / self.below[of[: len(near.code)]])
        self.base = np.log10((near.count + ADD) / self.floor)

    def steps(self, spark) -> DataFrame:
        """(prev, cls, step): of a word beyond the frequent ones, what its
        class adds to the score, by the class before: ``CLASSES`` squared rows."""
        prev, cls = np.divmod(np.arange(CLASSES * CLASSES), CLASSES)
        step = self.step.ravel() - np.log10(self.below)[cls]
        return spark.createDataFrame(pa.table({"prev": prev, "cls": cls, "step": step}))


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (word, cls, c) of the words beyond the frequent ones."""
    spark = training.sparkSession
    counts = stored(word_counts(training), "words")
    rows = counts.orderBy((F.col("word") == int(END)).desc(), F.desc("c"), "word").limit(NEAR).toArrow()
    near = Near(*(rows[x].to_numpy() for x in ("word", "suffix", "c")))
    given = spark.sparkContext.broadcast(near)
    met = stored(neighbours(training, given), "neighbours")
    of, into, table = frequent_classes(stored(met.where("at >= 0"), "frequent"), given)
    classes = stored(other_classes(met.where("at < 0"), of, table), "classes")
    members = np.bincount(of[: len(near.code)], minlength=CLASSES)
    total = into.copy()
    for r in classes.where("kind > 0").groupBy("kind", "word", "cls").agg(F.sum("c").alias("c")).collect():
        if r["kind"] == 1:
            total[r["word"], r["cls"]] += r["c"]
        else:
            members[r["cls"]] += r["c"]
    return Model(near, of, total, int(members.sum()), members), classes.where("kind = 0").select("word", "cls", "c")


PARTS = "row_id long, no_id boolean, text_key long, word long, prev long, own long, tf long, n_tokens long, n_known long, base double, score double, copies long"


def _parts(docs: DataFrame, model) -> DataFrame:
    """Of each text one row with the sums over its frequent words, and a row for
    each other word and class before it with their count ``tf``; ``own`` is the
    class of its suffix group, for words never seen. The text's own row has
    ``tf`` 0 and a word of its own, so it meets the join without weight."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(stream):
        m = model.value
        for batch in stream:
            for part in slices(batch, "text"):
                row, code, group, is_end = _tokens(part)
                n = part.num_rows
                at, place = m.near.find(code, group)
                cls = m.of[place]
                before = np.concatenate((cls[-1:], cls[:-1]))  # every text ends with an end, as the text before it
                seen = at >= 0
                score = np.bincount(row[seen], m.step[before[seen], cls[seen]] + m.word[at[seen]], n)
                base = np.bincount(row[seen], m.base[at[seen]], n)
                known = np.bincount(row[seen], minlength=n)
                size = np.bincount(row, minlength=n)
                row_id, key = part.column("row_id").to_numpy(), part.column("text_key").to_numpy()
                no_id = part.column("no_id").to_numpy(zero_copy_only=False)
                none, one = np.zeros(n, np.int64), np.ones(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (row_id, no_id, key, mix(key.view(np.uint64)).view(np.int64), none, none, none, size, known, base, score, one)], names
                )
                far = np.flatnonzero(~seen)
                far = far[np.lexsort((before[far], code[far], row[far]))]
                fresh = np.ones(len(far), bool)
                fresh[1:] = np.any([x[far[1:]] != x[far[:-1]] for x in (code, row, before)], axis=0)
                fresh = np.flatnonzero(fresh)
                tf, far = np.diff(fresh, append=len(far)), far[fresh]
                none, zero = np.zeros(len(far), np.int64), np.zeros(len(far))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (row_id[row[far]], no_id[row[far]], key[row[far]], code[far].view(np.int64), before[far], cls[far], tf, none, none, zero, zero, none)],
                    names,
                )

    return docs.mapInArrow(run, PARTS)


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``held_out``,
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``perplexity``; the model learns from the rows that are not held out.

    A null or empty text has one token, the end. Rows with a null doc_id are
    training rows. Repeated rows count as often as they occur and each return.
    Without training rows no word is known and all scores come from smoothing.
    Other columns are not read."""
    keyed = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("row_id"), F.isnull("doc_id").alias("no_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    training = keyed.where(~held_out(F.col("doc_id"))).select("text")
    model, classes = fit(training)
    given = docs.sparkSession.sparkContext.broadcast(model)
    parts = _parts(keyed.select("text", "row_id", "no_id", "text_key"), given)
    parts = parts.join(classes, "word", "left").withColumn("cls", F.coalesce("cls", "own"))
    parts = parts.join(F.broadcast(model.steps(docs.sparkSession)), ["prev", "cls"])
    c = F.coalesce("c", F.lit(0))
    tf = F.col("tf")
    sums = parts.groupBy("row_id", "no_id", "text_key").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, tf).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + tf * F.log10((c + ADD) / F.lit(float(model.floor)))).alias("base_score"),
        F.sum(F.col("score") + tf * (F.col("step") + F.log10(c + ADD))).alias("score"),
    )
    each = sums.select(
        F.when(~F.col("no_id"), F.col("row_id")).alias("doc_id"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
        *[(F.col(x) / F.col("copies")).cast(t).alias(x) for x, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))],
    )
    return each.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
