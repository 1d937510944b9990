"""Near-duplicate components by min-max hashing.

Each text becomes the set of its 5-word shingles. Every permutation gives two
signature values, the smallest and the largest hash, so 96 permutations give
192 values. 32 bands of four, each of four permutations, find candidates: a
pair at similarity 0.75 misses all of them with probability 5e-6, whatever the
size of the sets. One bit of each value makes a sketch of 192
bits; pairs that agree on fewer than 146 are dropped (at similarity 0.75 the
mean is 168, so one pair in a million is lost that way), which keeps texts that
merely share a passage from being compared in full. Members of crowded buckets
are also told apart by 1024 parity bits of their shingles: two sets differ in
at least as many shingles as parities, so no link is lost there.

Texts of equal sets collapse into one class before banding. A bucket's pairs
are never listed: members are compared with one pivot first, and only members
that are still in other components than a pivot go on, with 64 times as
many pivots a round, until every pair of a bucket is in one component or was
looked at. Each link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import add_columns, raw
from .components import components
from .tables import stored
from .words import SPACED, Words, mix

SHINGLE = 5
PERMUTATIONS = 96
BANDS, BAND = 32, 4
AGREED = 146
PARITY = 1024
MORE_PIVOTS = 64

_random = np.random.default_rng(41)
_FLIP = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_TIMES = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_PLACE = _random.integers(0, 1 << 63, max(SHINGLE, BAND)).astype(np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(data, offsets, SPACED)
    n = max(0, len(w) - SHINGLE + 1)
    value = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        value += w.hash[i : i + n] * _PLACE[i]
    value, sets = mix(value), []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(value[a : b - SHINGLE + 1]))
        elif b > a:
            whole = (w.hash[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def min_max(values: np.ndarray) -> np.ndarray:
    """Smallest and largest hash under each permutation."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        hashed = (short[i : i + 1024, None] ^ _FLIP) * _TIMES
        np.minimum(low, hashed.min(0), out=low)
        np.maximum(high, hashed.max(0), out=high)
    return np.stack((low, high), 1).ravel()


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash of each band. Its smallest and its largest values are of
    different permutations: those of one permutation do not agree independently
    in small sets."""
    half = BAND // 2
    of = signature.astype(np.uint64).reshape(PERMUTATIONS, 2)
    low, high = of[: BANDS * half, 0], of[-BANDS * half :, 1]
    values = np.hstack((low.reshape(BANDS, half), high.reshape(BANDS, half)))
    return mix((values * _PLACE[:BAND]).sum(1, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64)))


def sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each value, in 64-bit integers."""
    bits = (mix(signature.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def parities(values: np.ndarray) -> np.ndarray:
    """How many shingles fall on each of PARITY bits, modulo two."""
    odd = np.bincount((values % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame) -> DataFrame:
    """Adds ``n_shingles``, ``node`` (digest of the set; null if empty),
    ``buckets`` (one hash a band) and ``bits`` (the sketch, then the parities)
    to rows with ``text``, which goes."""
    longs = T.ArrayType(T.LongType())
    fields = [
        T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
        T.StructField("buckets", longs), T.StructField("bits", longs),
    ]

    def make():
        def work(part):
            sets = shingle_sets(*raw(part.column("text")))
            nodes, keys, bits = [], [], []
            for s in sets:
                signature = min_max(s) if len(s) else None
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(signature).view(np.int64) if len(s) else [])
                bits.append(np.concatenate((sketch(signature), parities(s))) if len(s) else [])
            longs = pa.list_(pa.int64())
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)]

        return work

    return add_columns(df, "text", fields, make, drop=("text",))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which 100 * intersection >= percent * union, counted on
    the full sets of both texts."""
    left = texts.select(F.col("id").alias("a"), "text")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("other"))
    rows = pairs.join(left, "a").join(right, "b")

    def make():
        def work(part):
            ones, others = shingle_sets(*raw(part.column("text"))), shingle_sets(*raw(part.column("other")))
            linked = []
            for x, y in zip(ones, others, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            return [pa.array(linked, pa.bool_())]

        return work

    checked = add_columns(rows, "text", [T.StructField("linked", T.BooleanType())], make, drop=("text", "other"))
    return checked.where("linked").select("a", "b")


SKETCH = range(PERMUTATIONS // 32)
WIDE = range(PERMUTATIONS // 32 + PARITY // 64)


def _look(words: range) -> Column:
    return F.struct("id", "n", *[F.col("bits")[i].alias(f"s{i}") for i in words]).alias("look")


def _apart(a: str, b: str, words: range) -> Column:
    return sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in words)


def _may_link(a: str, b: str, percent: int, words: range = SKETCH) -> Column:
    """Sizes and bits of the structs ``a`` and ``b`` allow a link."""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    near = (100 * low >= percent * high) & (_apart(a, b, SKETCH) <= 2 * PERMUTATIONS - AGREED)
    more = words[len(SKETCH) :]
    return near & ((100 + percent) * _apart(a, b, more) <= (100 - percent) * (low + high)) if more else near


def _pairs(buckets: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(a, b) of each member b and each of a bucket's pivots a in another
    component that may be linked: up to ``pivots`` of them, or every member of
    a bucket that has no more than that. Members that meet most others, like
    the text that all others were copied from, come first. ``buckets``:
    bucket, label, look."""
    size = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
    spread = buckets.join(size, "bucket")
    met_by = spread.groupBy(F.col("look.id").alias("id")).agg(F.sum("size").alias("met"))
    lot = F.when(F.col("size") <= pivots, F.col("look.id")).otherwise(F.pmod(F.xxhash64("look.id"), F.lit(pivots)))
    drawn = spread.join(met_by, F.col("look.id") == F.col("id")).groupBy("bucket", lot.alias("lot"))
    chosen = drawn.agg(F.max(F.struct("met", "look", "label")).alias("pivot"))
    chosen = chosen.select("bucket", F.col("pivot.look").alias("of"), F.col("pivot.label").alias("its"))
    met = buckets.join(chosen, "bucket").where(F.col("label") != F.col("its")).where(_may_link("look", "of", percent, WIDE))
    return met.select(F.least("of.id", "look.id").alias("a"), F.greatest("of.id", "look.id").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (id, node), and (node, label) with the ids of
    those that are linked with others."""
    spark = docs.sparkSession
    classes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("buckets").alias("buckets"),
        F.first("bits").alias("bits"), F.first("n_shingles").alias("n"),
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    looks = classes.select("id", _look(WIDE))
    members = classes.select(_look(SKETCH), F.explode("buckets").alias("bucket"))
    pivot = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("look").alias("of")).where("size > 1")
    shared = members.join(pivot.select("bucket", "of"), "bucket").select(
        "bucket", "look.id", F.col("of.id").alias("a"), _may_link("look", "of", percent).alias("near")
    )
    shared = stored(shared, "shared")
    fresh = stored(shared.where("near AND a <> id").select("a", F.col("id").alias("b")).distinct(), "pairs")

    wanted = classes.join(shared.select("id").distinct(), "id").select("id", "of.doc_id", "of.text_key")
    have = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")
    found = have.join(wanted.hint("shuffle_hash"), (have.doc_id.eqNullSafe(wanted.doc_id)) & (have.text_key == wanted.text_key))
    texts = stored(found.select("id", "text"), "texts")

    open_buckets = shared.select("bucket", "id")
    edges, tried, pivots = None, fresh, 0
    while True:
        confirmed_now = stored(confirmed(fresh, texts, percent), "edges")
        edges = confirmed_now if edges is None else edges.union(confirmed_now)
        labels = components(edges)
        named = open_buckets.join(labels.withColumnRenamed("node", "id"), "id", "left")
        named = named.select("bucket", "id", F.coalesce("label", "id").alias("label"))
        mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        named = stored(named.join(mixed.select("bucket"), "bucket"), "open")
        largest = named.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        if largest <= pivots:
            return classes.select("id", "node"), labels
        pivots = max(1, pivots * MORE_PIVOTS)
        seen = _pairs(named.join(looks, "id").drop("id"), pivots, percent)
        fresh = stored(seen.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(fresh)
        open_buckets = named.select("bucket", "id")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest doc_id that links reach) and ``kept``.

    A text of fewer than five words is one shingle; null, empty and blank
    texts have none and are linked with nothing. Repeated rows each return.
    A null doc_id is its own component unless links reach a document with an
    id. Other columns are not read."""
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("text_key", F.unhex(F.md5("text")))
    rows = stored(signatures(keyed), "signatures")
    classes, labels = links(docs, rows, percent)
    named = rows.groupBy("node").agg(F.min("doc_id").alias("least")).where("node is not null").join(classes, "node")
    named = named.join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("node", "least", F.coalesce("label", "id").alias("label"))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(groups, "label").select("node", "component_id")
    out = rows.join(of, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the document of
    the smallest id, once if the row repeats."""
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, docs.doc_id.eqNullSafe(kept["_kept"]), "left_semi")
    return rows.withColumn("_key", F.md5("text")).dropDuplicates(["doc_id", "_key"]).drop("_key")
