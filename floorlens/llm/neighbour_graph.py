"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors become one node, so a vector that fills a third of the table is a
single node with its smallest ids. The graph starts from small blocks of nodes
that share a near pivot and is improved by joins: every node meets the
neighbours of its neighbours (both directions), pairs that beat a neighbour list
enter it, and only pairs with an edge of the last round are looked at again. A
query starts at its own node and at near pivots and expands the best nodes of
its beam until none is left to expand.

Graph and beam use unit vectors in single precision; the nodes of a final beam are
scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .tables import stored

#: Neighbours of a node, and as many more that it is a neighbour of.
DEGREE = 32
#: Improving partners that a node is told of at one common neighbour and round.
TOLD = 8
#: Rounds end when fewer than this share of the neighbours is new.
SETTLED = 0.02
#: Pivots are a sample: one of so many nodes, and this many at most.
PER_PIVOT, PIVOTS = 64, 1024
CELLS = 3  # near pivots whose blocks a node joins
BLOCK = 256  # nodes of a block, about
#: Nodes that a query keeps, and expands in one step.
BEAM, STEP = 256, 48
STARTS = 4
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows, for rows that hold many vectors."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def usable(vector: str = "embedding") -> Column:
    """True for vectors of finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, kind).reshape(-1, width)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def units(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def packed(df: DataFrame, width: int) -> DataFrame:
    """Replaces ``embedding`` by ``exact`` (float64) and ``unit`` (float32), both
    ``width`` components; shorter vectors go on with zeros."""
    names = [c for c in df.columns if c != "embedding"]
    fields = [f for f in df.schema.fields if f.name != "embedding"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            vectors = batch.column("embedding")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(int)
            rows = np.zeros((batch.num_rows, width))
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows[np.repeat(np.arange(len(sizes)), sizes), at] = vectors.flatten().to_numpy(zero_copy_only=False)
            short = units(rows).astype(np.float32) if len(rows) else rows
            made = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (rows, short)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "exact", "unit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "exact binary", "unit binary"])
    return df.mapInArrow(run, schema)


def nodes(vectors: DataFrame, k: int, wide: int) -> tuple[DataFrame, int]:
    """(node, ids, embedding, exact, unit): distinct vectors with the ``k`` + 1
    smallest ids of each (no other of its ids can be among ``k`` nearest), and the
    number of components, ``wide`` at least."""
    kept = vectors.select("vec_id", "embedding").where(usable())
    least = Window.partitionBy("embedding").orderBy(F.asc_nulls_last("vec_id"))
    few = kept.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "vec_id"))), lambda x: x["vec_id"]).alias("ids")
    classes = few.groupBy("embedding").agg(ids).withColumn("width", F.size("embedding"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    width = max(wide, classes.agg(F.max("width")).first()[0] or 1)
    return stored(packed(classes.drop("width").withColumn("key", F.col("embedding")), width), "nodes"), width


class Pivots:
    """A bounded sample of nodes: those whose vectors have the smallest hashes."""

    def __init__(self, points: DataFrame, width: int):
        n = points.count()
        self.of = n
        rows = points.orderBy(F.xxhash64("key"), "node").select("node", "unit").limit(min(PIVOTS, n // PER_PIVOT + 1)).collect()
        self.nodes = np.array([r["node"] for r in rows], np.int64)
        self.units = np.frombuffer(b"".join(bytes(r["unit"]) for r in rows), np.float32).reshape(-1, width)

    def nearest(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of up to ``k`` near pivots of each row."""
        near = rows @ self.units.T
        k = min(k, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        return at, np.take_along_axis(near, at, 1)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar neighbours ``v`` of each ``u``."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def seeds(points: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """First edges (u, v, sim): the nearest within blocks of about ``BLOCK`` nodes
    that share one of their ``CELLS`` nearest pivots."""

    def cells(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at, _ = pivots.nearest(matrix(batch.column("unit"), np.float32, width), CELLS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), lists], ["node", "unit", "cells"])

    def within(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for group in batch.column("held"):
                held = group.values
                ids = held.field("node").to_numpy()
                if len(ids) < 2:
                    continue
                rows = matrix(held.field("unit"), np.float32, width)
                near = rows @ rows.T
                np.fill_diagonal(near, -9)
                k = min(DEGREE, len(ids) - 1)
                at = np.argpartition(-near, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(near, at, 1).ravel())], ["u", "v", "sim"])

    dealt = points.select("node", "unit").mapInArrow(cells, "node long, unit binary, cells array<int>")
    dealt = stored(dealt.select("node", "unit", F.explode("cells").alias("cell")), "cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("node", "cell"), F.col("blocks"))
    groups = dealt.join(F.broadcast(sizes), "cell").groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("node", "unit")).alias("held"))
    return groups.select("held").mapInArrow(within, "u long, v long, sim float").groupBy("u", "v").agg(F.max("sim").alias("sim"))


def meetings(width: int):
    """Rows (near: list of v, fresh, least, unit) to (u, v, sim): pairs of
    neighbours of one node that would enter the list of ``u``."""

    def pairs(ids, fresh, least, rows, u, v) -> Iterator[pa.RecordBatch]:
        most = int(max(v, 1))
        near = rows @ rows.transpose(0, 2, 1)
        bad = (ids[:, :, None] == ids[:, None, :]) | (ids[:, None, :] < 0) | ~(fresh[:, :, None] | fresh[:, None, :])
        near[bad | (near <= least[:, :, None])] = -9
        told = min(TOLD, most)
        at = np.argpartition(-near, told - 1, axis=2)[:, :, :told]
        sim = np.take_along_axis(near, at, 2)
        row, a, b = np.nonzero(sim > -5)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row, a]), pa.array(ids[row, at[row, a, b]]), pa.array(sim[row, a, b])], ["u", "v", "sim"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, BLOCK):
                lists = batch.column("near").slice(start, BLOCK)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
                held = lists.flatten()
                row = np.repeat(np.arange(len(sizes)), sizes)
                flat = {c: held.field(c).to_numpy(zero_copy_only=False) for c in ("v", "fresh", "least")}
                # Both directions of an edge: once, and fresh if either is.
                order = np.lexsort((~flat["fresh"], flat["v"], row))
                first = np.ones(len(order), bool)
                first[1:] = (row[order][1:] != row[order][:-1]) | (flat["v"][order][1:] != flat["v"][order][:-1])
                order = order[first]
                row = row[order]
                sizes = np.bincount(row, minlength=len(sizes))
                at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                shape = (len(sizes), int(sizes.max(initial=1)))
                ids, fresh, least = np.full(shape, -1), np.zeros(shape, bool), np.full(shape, 9, np.float32)
                rows = np.zeros((*shape, width), np.float32)
                ids[row, at], fresh[row, at], least[row, at] = (flat[c][order] for c in ("v", "fresh", "least"))
                rows[row, at] = matrix(held.field("unit"), np.float32, width)[order]
                yield from pairs(ids, fresh, least, rows, *shape)

    return run


def graph(points: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """(u, v, sim): ``DEGREE`` near neighbours of every node, found by NN-descent."""
    spark = points.sparkSession
    edges = stored(best(seeds(points, pivots, width), DEGREE).withColumn("fresh", F.lit(True)), "edges")
    fresh = edges.count()
    while fresh > SETTLED * DEGREE * pivots.of:
        back = best(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "fresh"), DEGREE)
        both = edges.unionByName(back).drop("sim")
        full = F.count("*") >= DEGREE
        least = edges.groupBy(F.col("u").alias("v")).agg(F.when(full, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        known = points.select(F.col("node").alias("v"), "unit").join(least, "v", "left").withColumn("least", F.coalesce("least", F.lit(-2.0).cast("float")))
        near = both.join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "fresh", "least", "unit")).alias("near"))
        met = near.select("near").mapInArrow(meetings(width), "u long, v long, sim float").withColumn("fresh", F.lit(True))
        union = edges.withColumn("fresh", F.lit(False)).unionByName(met)
        merged = union.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        with batches_of(spark, 4 * BLOCK):
            edges = stored(best(merged, DEGREE), "edges")
        fresh = edges.where("fresh").count()
    return edges.select("u", "v", "sim")


def beams(width: int):
    """Rows (query, unit, held, sims, open, found) to (query, unit, held, sims,
    open, todo): the beam with what a step has found, and what to expand next."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out: list[list] = [[], [], [], []]
            for unit, held, sims, fresh, found in zip(*(batch.column(c) for c in ("unit", "held", "sims", "open", "found")), strict=True):
                ids = np.frombuffer(held.as_py(), np.int64)
                sim, still = np.frombuffer(sims.as_py(), np.float32), np.frombuffer(fresh.as_py(), bool)
                if found.values is not None and len(found.values):
                    new = found.values.field("node").to_numpy()
                    rows = matrix(found.values.field("unit"), np.float32, width)
                    at = np.flatnonzero(~np.isin(new, ids))
                    ids = np.concatenate((ids, new[at]))
                    sim = np.concatenate((sim, rows[at] @ np.frombuffer(unit.as_py(), np.float32)))
                    still = np.concatenate((still, np.ones(len(at), bool)))
                order = np.lexsort((ids, -sim))[:BEAM]
                ids, sim, still = ids[order], sim[order].astype(np.float32), still[order].copy()
                todo = np.flatnonzero(still)[:STEP]
                still[todo] = False
                for column, value in zip(out, (ids.tobytes(), sim.tobytes(), still.tobytes(), ids[todo]), strict=True):
                    column.append(value)
            kinds = pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())
            arrays = [batch.column("query"), batch.column("unit"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["query", "unit", "held", "sims", "open", "todo"])

    return run


def walked(asked: DataFrame, points: DataFrame, edges: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """(query, node): the final beam of each row of ``asked`` (query, unit, own);
    ``own``: the node of an equal vector, or null."""
    spark = asked.sparkSession
    state = "query long, unit binary, held binary, sims binary, open binary, todo array<long>"
    found = "array<struct<node:long,unit:binary>>"

    def begin(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at, _ = pivots.nearest(matrix(batch.column("unit"), np.float32, width), STARTS)
            starts = [[n for n in {o, *near} if n is not None] for o, near in zip(batch.column("own").to_pylist(), pivots.nodes[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(starts, pa.list_(pa.int64()))], ["query", "node"])

    adjacent = stored(edges.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("near")), "adjacency")
    vectors = points.select("node", "unit")
    beam = asked.select("query", "unit", *(F.lit(b"").alias(c) for c in ("held", "sims", "open")))
    reached = asked.mapInArrow(begin, "query long, node array<long>").select("query", F.explode("node").alias("node"))
    while True:
        vecs = reached.join(vectors, "node").groupBy("query").agg(F.collect_list(F.struct("node", "unit")).alias("found"))
        step = beam.join(vecs, "query", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {found})")))
        with batches_of(spark, BLOCK):
            beam = stored(step.select("query", "unit", "held", "sims", "open", "found").mapInArrow(beams(width), state), "beams")
        todo = beam.select("query", F.explode("todo").alias("node"))
        if todo.isEmpty():
            break
        reached = todo.join(adjacent, "node").select("query", F.explode("near").alias("node")).distinct()
        beam = beam.drop("todo")

    def members(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("held")]
            query = np.repeat(batch.column("query").to_numpy(), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))], ["query", "node"])

    return beam.select("query", "held").mapInArrow(members, "query long, node long")


def scores(pairs: DataFrame, width: int) -> DataFrame:
    """(query, node, score) of rows (query, node, a, b): the cosine of two
    original vectors in double precision."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = (scaled(matrix(batch.column(c), np.float64, width)) if batch.num_rows else np.zeros((0, width)) for c in "ab")
            cos = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(cos)], ["query", "node", "score"])

    return pairs.select("query", "node", "a", "b").mapInArrow(run, "query long, node long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): near rows of ``vectors`` (vec_id,
    embedding) of each row of ``queries``, nearest first, ties to the smaller
    ``vec_id``, null last; ``score`` is the cosine.

    A query's own row, one with its id and its vector, is no candidate. Vectors
    that are null, all zero or hold a null or non-finite component take no part;
    where lengths differ, the shorter one goes on with zeros. Repeated rows of
    ``vectors`` are candidates each, repeated queries count once. Without a
    candidate a query has no rows, and an empty table gives none. Other columns
    are not read."""
    asked = queries.select("vec_id", "embedding").where(usable()).distinct()
    wide = asked.agg(F.max(F.size("embedding"))).first()[0] or 1
    points, width = nodes(vectors, k, wide)
    pivots = Pivots(points, width)
    spark = vectors.sparkSession
    if not pivots.of:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    edges = graph(points, pivots, width)
    own = points.select(F.col("key").alias("embedding"), F.col("node").alias("own"))
    asked = packed(asked.join(own, "embedding", "left").withColumn("query", F.monotonically_increasing_id()), width)
    asked = stored(asked, "asked")
    pairs = walked(asked.select("query", "unit", "own"), points, edges, pivots, width)
    pairs = pairs.join(points.select("node", F.col("exact").alias("b")), "node").join(asked.select("query", F.col("exact").alias("a")), "query")
    first = Window.partitionBy("query").orderBy(F.desc("score"))
    near = scores(pairs, width).withColumn("nth", F.rank().over(first)).where(F.col("nth") <= k + 1)
    each = near.join(points.select("node", "ids"), "node").join(asked.select("query", F.col("vec_id").alias("query_id"), "own"), "query")
    mine = F.when(F.col("node") == F.col("own"), F.array_position("ids", F.col("query_id")) - 1)
    each = each.select("query", "query_id", "score", mine.alias("mine"), F.posexplode("ids").alias("nth", "vec_id"))
    each = each.where(F.col("mine").isNull() | (F.col("mine") != F.col("nth")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
