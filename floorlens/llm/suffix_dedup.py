"""Bytes covered by a string of ``WIDTH`` bytes that also starts elsewhere.

1. Winnowing gives every window of WIDTH bytes an anchor: its gram of smallest
   hash, the last one on a tie. Equal windows have equal anchors at equal
   offsets, so windows whose anchor occurs once are out.
2. The windows of one anchor lie side by side; the bytes they span are its
   context. Equal contexts settle each other: all of their bytes are repeated.
   What is left are anchors with several different contexts.
3. Their windows are dealt into cells by where the anchor is in them, keyed by
   the bytes all windows of a cell share. Cells whose shared bytes are unique
   drop out and equal ones settle; in the others only the bytes on both sides
   of the shared ones can differ.
4. Those cells meet, key by key, in a Burrows-Wheeler transform of a bounded
   chunk, the shared bytes standing there as one symbol, and interval expansion
   up to the remaining length finds the windows that are equal.
5. A key with more than ``CROWD`` different cells does not go to one chunk: its
   cells are halved, which lengthens the shared bytes, down to single windows,
   which always settle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import add_columns, raw, returning, slices
from .bwt import common_prefix_classes
from .tables import stored
from .words import BASE, BYTE, UNBASE, mix, powers

WIDTH = 400
GRAM = 16
CELL = 64
CROWD = 1000
CHUNK = 1_500_000
STRETCH = 1 << 22

ROW = "row_id long, text_key long"
RUN = f"{ROW}, begin long, stop long"
SHARED = 256 + 2  # the symbol of a cell's shared bytes


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    return mix(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + mix(x[8:]))


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(place, hash, first window, last window) of the anchors of several
    texts. A text beyond STRETCH bytes may repeat an anchor with the next of
    its windows."""
    span = width - GRAM + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    found = [np.zeros((4, 0), np.int64)]
    for a in range(0, max(0, len(data) - width + 1), STRETCH):
        code = grams(data[a : a + STRETCH + width - 1])
        low = (code & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(code), dtype=np.uint64))
        covered = 1
        while covered * 2 <= span:
            low = np.minimum(low[:-covered], low[covered:])
            covered *= 2
        if covered < span:
            low = np.minimum(low[: covered - span], low[span - covered :])
        window = np.flatnonzero(np.arange(a, a + len(low)) + width <= ends[a : a + len(low)])
        place = 0xFFFFFF - (low[window] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first] if len(place) else place
        found.append(np.stack((place + a, code[place].view(np.int64), window[first] + a, window[last] + a)) if len(place) else found[0])
    return tuple(np.concatenate(found, 1))


def pack(place, before, span):
    """One integer of an anchor's place, how far before it its first window
    starts, and how much later its last."""
    return place << 20 | before << 10 | span


def unpack(spot):
    return spot >> 20, spot >> 10 & 1023, spot & 1023


def _anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(key, c, row_id, text_key, spot): each anchor of each text, the hash of
    its gram and of its context."""
    names = ["key", "c", "row_id", "text_key", "spot"]

    def run(stream):
        for batch in stream:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                place, code, first, last = anchors(data, offsets, width)
                row = np.searchsorted(offsets, place, side="right") - 1
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(BYTE[data] * powers(BASE, len(data)), out=total[1:])
                context = mix((total[last + width] - total[first]) * powers(UNBASE, len(data) + 1)[first])
                context = mix(context + pack(place - place, place - first, last - first).astype(np.uint64))
                row_id, key = (part.column(x).to_numpy()[row] for x in ("row_id", "text_key"))
                spot = pack(place - offsets[row], place - first, last - first)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code, context.view(np.int64), row_id, key, spot)], names)

    return docs.mapInArrow(returning(run), f"key long, c long, {ROW}, spot long")


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _cells(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The cells of each wanted anchor (row_id, text_key, spot): ``begin`` is a
    cell's first window, ``left`` and ``right`` its bytes beside the shared."""
    grouped = wanted.groupBy("row_id", "text_key").agg(F.collect_list("spot").alias("spots"))
    rows = docs.join(grouped.hint("shuffle_hash"), ["row_id", "text_key"])
    core = width - CELL + 1

    def cells(data, spot):
        place, before, span = unpack(spot)
        for number in range((before - span) // CELL, before // CELL + 1):
            most, least = min(before, number * CELL + CELL - 1), max(before - span, number * CELL)
            at = place - number * CELL  # where the shared bytes begin
            left, right = data[place - most : at], data[at + core : place - least + width]
            key = _hash(bytes([number]), data[at : at + core])
            yield key, _hash(bytes([len(left)]), left, right), place - most, left, right

    def run(stream):
        names = ["key", "c", "begin", "left", "right", "row_id", "text_key"]
        for batch in stream:
            for row, key, text, spots in zip(*(batch.column(c) for c in ("row_id", "text_key", "text", "spots")), strict=True):
                data, spots = text.as_py().encode(), spots.values.to_numpy().tolist()
                for i in range(0, len(spots), 5000):
                    columns = list(zip(*(c for spot in spots[i : i + 5000] for c in cells(data, spot)), strict=True))
                    n = len(columns[0])
                    kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 2
                    columns += [[row.as_py()] * n, [key.as_py()] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(returning(run), f"key long, c long, begin long, left binary, right binary, {ROW}")


def _classes(rows: DataFrame, one: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows with a key and a content hash c: the contents that occur more
    than once, and one row (columns ``one``) of each content of the keys with
    several contents, with their number ``several``."""
    contents = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct(*one)).alias("one"))
    contents = stored(contents, "contents")
    crowd = contents.groupBy("key").agg(F.count("*").alias("several")).where("several > 1")
    return contents.where("n > 1").select("key", "c"), contents.join(crowd, "key").select("key", "several", "one.*")


def _halves(cells: DataFrame, size: int) -> DataFrame:
    """Cells of up to ``size`` windows dealt into two; ``size`` is even."""
    half = size // 2
    left, right = F.length("left"), F.length("right")
    least = size - 1 - right  # windows of a cell use ``least`` to ``left`` bytes of the left side
    begin = F.col("begin")
    near = cells.where(least < half).select(
        F.xxhash64("key", F.lit(0), F.substring("right", 1, half)).alias("key"),
        (begin + left - F.least(left, F.lit(half - 1))).alias("begin"),
        F.expr(f"substring(left, length(left) - least(length(left), {half - 1}) + 1)").alias("left"),
        F.expr(f"substring(right, {half} + 1)").alias("right"), "row_id", "text_key",
    )
    far = cells.where(left >= half).select(
        F.xxhash64("key", F.lit(1), F.expr(f"substring(left, length(left) - {half} + 1)")).alias("key"), "begin",
        F.expr(f"substring(left, 1, length(left) - {half})").alias("left"),
        F.expr(f"substring(right, 1, least(length(right), {half - 1}))").alias("right"), "row_id", "text_key",
    )
    return near.union(far).withColumn("c", F.xxhash64(F.length("left"), F.concat("left", "right")))


def _equal_windows(cells: DataFrame, size: int, width: int, partitions: int) -> DataFrame:
    """Covered runs by transforms of bounded chunks, in which all cells of one
    key lie together."""
    dealt = cells.repartition(partitions, "key").sortWithinPartitions("key")

    def solve(group):
        lengths = np.array([len(g[4]) + 1 + len(g[5]) for g in group])
        begins = np.cumsum(lengths) - lengths
        marks = begins + np.array([len(g[4]) for g in group])
        symbols = np.full(lengths.sum(), SHARED, np.int64)
        plain = np.ones(len(symbols), bool)
        plain[marks] = False
        symbols[plain] = np.frombuffer(b"".join(x for g in group for x in g[4:6]), np.uint8).astype(np.int64) + 1
        cls, owner, offset = common_prefix_classes(symbols, lengths, size)
        if not len(cls):
            return
        # a class of equal windows is one of equal shared bytes too: parts of equal keys
        key = np.array([g[0] for g in group])[owner]
        order = np.lexsort((key, cls))
        cls, key, owner, offset = cls[order], key[order], owner[order], offset[order]
        cuts = np.flatnonzero((np.diff(cls, prepend=-1) != 0) | (np.diff(key, prepend=key[:1]) != 0))
        hit = np.repeat(np.diff(cuts, append=len(cls)) > 1, np.diff(cuts, append=len(cls)))
        owner, offset = owner[hit], offset[hit]
        if not len(owner):
            return
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1))
        last = np.append(first[1:], len(owner)) - 1
        for o, a, b in zip(owner[first].tolist(), offset[first].tolist(), offset[last].tolist(), strict=True):
            _, row_id, text_key, begin, _, _ = group[o]
            yield row_id, text_key, begin + a, begin + b + width

    def run(stream):
        group, held, last = [], 0, None

        def flush():
            found = list(zip(*solve(group), strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["row_id", "text_key", "begin", "stop"])

        for batch in stream:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "row_id", "text_key", "begin", "left", "right")), strict=True):
                if held > CHUNK and row[0] != last:
                    yield flush()
                    group, held = [], 0
                group.append(row)
                held += len(row[4]) + len(row[5]) + 2
                last = row[0]
        if group:
            yield flush()

    return dealt.mapInArrow(returning(run), RUN)


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row_id, text_key, begin, stop) of byte runs, perhaps overlapping, whose
    union is what equal windows cover. ``docs``: row_id, text, text_key."""
    found = stored(_anchor_rows(docs, width), "anchors")
    repeated, several = _classes(found, ["row_id", "text_key", "spot"])
    place, before, span = unpack_columns()
    first = place - before
    settled = [stored(found.join(repeated, ["key", "c"]).select("row_id", "text_key", first.alias("begin"), (first + span + width).alias("stop")), "runs")]
    cells, size = _cells(docs, several, width), CELL
    one = ["begin", "left", "right", "row_id", "text_key"]
    while True:
        cells = stored(cells, "cells")
        repeated, several = _classes(cells.select("key", "c", *one), one)
        several = stored(several, "several")
        used = F.length("left") + F.length("right") - (size - 1)  # windows of the cell but one
        equal = cells.join(repeated, ["key", "c"])
        settled.append(stored(equal.select("row_id", "text_key", "begin", (F.col("begin") + used + width).alias("stop")), "runs"))
        small = several.where(F.col("several") <= CROWD)
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), small.count() * 2 * size // (4 * CHUNK) + 1)
        settled.append(stored(_equal_windows(small, size, width, partitions), "runs"))
        cells = several.where(F.col("several") > CROWD)
        if size == 1 or cells.isEmpty():
            break
        cells, size = _halves(cells, size), size // 2
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def unpack_columns():
    spot = F.col("spot")
    return F.shiftright(spot, 20), F.shiftright(spot, 10).bitwiseAND(1023), spot.bitwiseAND(1023)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (the remaining bytes) to each row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes, texts below ``width`` bytes lose none.
    Repeated rows are each other's copies: all of their windows are removed.
    Columns of the same names are replaced; null ids are ids like others."""
    fields = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()),
    ]
    keyed = docs.drop("row_id", "text_key", "runs", *(f.name for f in fields)).withColumns({
        "row_id": F.coalesce("doc_id", F.lit(0)), "text_key": F.xxhash64(F.isnull("doc_id"), "text"),
    })
    runs = repeated_runs(keyed.select("row_id", "text", "text_key").where(F.octet_length("text") >= width), width)
    grouped = runs.groupBy("row_id", "text_key").agg(F.collect_list(F.struct("begin", "stop")).alias("runs"))
    rows = keyed.join(grouped.hint("shuffle_hash"), ["row_id", "text_key"], "left")

    def make():
        def work(part):
            size, removed, spans, kept = [], [], [], []
            for text, runs in zip(part.column("text"), part.column("runs"), strict=True):
                data = (text.as_py() or "").encode()
                edge = np.zeros(len(data) + 1, np.int32)
                if runs.is_valid:
                    a, b = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
                    np.add.at(edge, a, 1)
                    np.add.at(edge, np.minimum(b, len(data)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                size.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0)))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if removed[-1] else data)
            numbers = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            return [*numbers, pa.array(kept, pa.binary())]

        return work

    return add_columns(rows, "text", fields, make, drop=("text", "runs", "row_id", "text_key"))


def cut(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (a character of
    which a byte is gone goes whole); a text of which nothing is left goes, and
    all others, null and empty ones too, stay."""

    def make():
        def work(part):
            left = [None if x is None else x.decode("utf-8", "ignore") for x in part.column("kept").to_pylist()]
            return [pa.array(left, pa.string())]

        return work

    done = without_repeats(docs.withColumn("_none", F.isnull("text")), width).where("n_bytes = 0 OR n_removed < n_bytes")
    out = add_columns(done, "kept", [T.StructField("text", T.StringType())], make, drop=("kept",))
    return out.withColumn("text", F.when(~F.col("_none"), F.col("text"))).select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    done = without_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
