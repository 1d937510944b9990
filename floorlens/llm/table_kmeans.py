"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors become integers once and are stored in blocks: per dimension the values
that occur in the block, and each vector's place among them. A round tabulates,
for each dimension, occurring value and centroid, the squared difference; the
distance of a vector is a sum of table entries that its places gather. Nothing
but the centroids and their sums (``k`` by ``DIMENSIONS``) leaves the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

DIMENSIONS = 64
SCALE = 64
#: Components beyond this are cut to it, so that a squared distance fits 64 bits.
MOST = 1 << 27
BLOCK_ROWS = 4096
ROUNDS = 3


def whole(vector: str = "embedding") -> Column:
    """True for vectors of ``DIMENSIONS`` finite components."""
    ok = (F.size(vector) == DIMENSIONS) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def integers(vector: str = "embedding") -> Column:
    """floor(``SCALE`` * x) of every component, within plus or minus ``MOST``."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x.cast("double") * SCALE))).cast("int"))


def blocks(vectors: DataFrame) -> DataFrame:
    """(ids, known, sizes, values, places) from (vec_id, v): rows of a task, up to
    ``BLOCK_ROWS`` together. ``values`` has the values of dimension 0, then of 1,
    and so on; ``sizes`` how many each has; ``places`` each vector's entry in
    ``values``, dimension by dimension."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                rows = part.column("v").flatten().to_numpy().reshape(-1, DIMENSIONS)
                values, places, sizes, before = [], np.empty(rows.shape[::-1], np.int32), [], 0
                for d in range(DIMENSIONS):
                    seen, at = np.unique(rows[:, d], return_inverse=True)
                    values.append(seen)
                    places[d] = at.reshape(-1) + before
                    before += len(seen)
                    sizes.append(len(seen))
                ids = part.column("vec_id")
                known = np.asarray(ids.is_valid())
                columns = (ids.fill_null(0).to_numpy(zero_copy_only=False), known, np.array(sizes, np.int32), np.concatenate(values), places)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["ids", "known", "sizes", "values", "places"])

    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, known binary, sizes binary, values binary, places binary")


def distances(sizes: np.ndarray, values: np.ndarray, places: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals) and squared distance of each vector
    of a block, from tables of squared differences."""
    dimension = np.repeat(np.arange(DIMENSIONS), sizes)
    best = np.full(places.shape[1], np.iinfo(np.int64).max)
    nearest = np.zeros(places.shape[1], np.int32)
    for k, centre in enumerate(centroids):
        table = (values.astype(np.int64) - centre[dimension]) ** 2
        total = np.zeros(places.shape[1], np.int64)
        for at in places:
            total += table[at]
        closer = total < best
        best[closer], nearest[closer] = total[closer], k
    return nearest, best


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, known, sizes, values, places) of each block."""
    kinds = np.int64, np.bool_, np.int32, np.int32, np.int32
    for row in zip(*batch.columns, strict=True):
        ids, known, sizes, values, places = (np.frombuffer(x.as_py(), t) for x, t in zip(row, kinds, strict=True))
        yield ids, known, sizes, values, places.reshape(DIMENSIONS, -1)


def sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, totals): members and component sums of each cluster, one row
    a task and cluster."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), DIMENSIONS), np.int64)
        for batch in stream:
            for _, _, sizes, values, places in unpacked(batch):
                nearest, _ = distances(sizes, values, places, centroids)
                n += np.bincount(nearest, minlength=len(centroids))
                for k in np.unique(nearest):
                    total[k] += values[places[:, nearest == k]].sum(1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "totals"])

    return packed.mapInArrow(run, "cluster int, n long, totals array<long>")


def assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for ids, known, sizes, values, places in unpacked(batch):
                nearest, far = distances(sizes, values, places, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(nearest), pa.array(far)], ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256; vectors that share
    an id are ordered by their components, a null id counts as an empty one."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", mark.alias("mark")).orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMENSIONS)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid with members goes to floor(sum / count) of each
    component, exactly."""
    each = sums(packed, centroids).select("cluster", "n", F.posexplode("totals").alias("d", "total"))
    exact = each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    fresh = centroids.copy()
    for r in exact.where("n > 0").collect():
        fresh[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    return fresh


def long_sum(column: str) -> Column:
    """An exact sum, cut to the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    every vector of ``embeddings`` (vec_id, embedding) with ``DIMENSIONS`` finite
    components; all others, null ones too, take no part.

    Ties go to the centroid with the smaller number. Repeated rows count each, so
    two centroids may start alike; the later one then stays without members, and
    where it is. With fewer vectors than ``k`` there are fewer centroids; an empty
    table gives no rows. Other columns are not read."""
    spark = embeddings.sparkSession
    vectors = embeddings.where(whole()).select("vec_id", integers().alias("v"))
    centroids = first_centroids(vectors, k, seed)
    packed = stored(blocks(vectors), "blocks")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(packed, centroids)
    found = stored(assigned(packed, centroids), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(long_sum("distance").alias("inertia")).collect()}
    total = min(sum(inertia.values()), (1 << 63) - 1)
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(i, inertia.get(i, 0), total, mark) for i, mark in enumerate(marks)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
