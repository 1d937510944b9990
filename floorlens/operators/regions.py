"""Connected regions of scanline spans and their outlines, in two levels.

Floors are cut into tiles of `TILE_M` by `TILE_M`. One pass over the rows of a
tile labels the regions inside it, or strings boundary edges into chains; what
crosses a tile's border is a small table, and only that is joined: labels by
their smallest label, chains by pointer doubling over their next links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .coverage import PITCH_M, components, spans
from .spatial import FLOOR

TILE_M = 64.0
TILE = [*FLOOR, "row", "column"]
NODE = "struct<row:long,column:long,part:int>"
# Narrower gaps and runs are what rounding leaves where two sights meet.
SLIVER_M = 1e-6
# Directions of a boundary edge; the region lies to its left.
EAST, NORTH, WEST, SOUTH = range(4)


def runs(elementary: DataFrame, covered: bool) -> DataFrame:
    """Maximal covered or blind runs of every scanline."""
    s = elementary.where("cameras > 0" if covered else "cameras = 0")
    w = Window.partitionBy(*FLOOR, "line").orderBy("x1")
    fresh = F.coalesce(F.col("x1") > F.lag("x2").over(w) + SLIVER_M, F.lit(True)).cast("int")
    return (
        s.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(w))
        .groupBy(*FLOOR, "line", "run")
        .agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
        .where(F.col("x2") - F.col("x1") > SLIVER_M)
    )


def by_column(runs: DataFrame, tile: float) -> DataFrame:
    """Runs cut where a column of tiles ends."""
    c = F.col("column") * tile
    cells = F.sequence(F.floor(F.col("x1") / tile), F.ceil(F.col("x2") / tile) - 1)
    return runs.withColumn("column", F.explode(cells)).withColumns({"x1": F.greatest("x1", c), "x2": F.least("x2", c + tile)})


def _rows(columns: dict, schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(columns[n], t) for n, t in schema], [n for n, _ in schema])


KEYS = [("building_id", pa.int64()), ("ordinal", pa.int32()), ("row", pa.int64()), ("column", pa.int64())]
PARTS = [*KEYS, ("part", pa.int32()), ("side", pa.string()), ("line", pa.int64()), ("x1", pa.float64()), ("x2", pa.float64()), ("last", pa.int64()), ("length", pa.float64())]


def _labelled(tile_m: float, lines: int):
    """Tile of runs to its regions (side `all`: lines, extent, length) and the
    runs that lie on its border (sides left, right, low, high)."""

    def label(key, tile):
        line, x1, x2 = (tile[c].to_numpy() for c in ("line", "x1", "x2"))
        order = np.lexsort((x1, line))
        line, x1, x2 = line[order], x1[order], x2[order]
        parent = list(range(len(line)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        starts = np.searchsorted(line, np.arange(line[0], line[-1] + 3))
        for k in range(int(line[-1] - line[0])):
            a, b, c = starts[k], starts[k + 1], starts[k + 2]
            first = b + np.searchsorted(x2[b:c], x1[a:b], side="right")
            stop = b + np.searchsorted(x1[b:c], x2[a:b], side="left")
            for i, lo, hi in zip(range(a, b), first.tolist(), stop.tolist(), strict=True):
                for j in range(lo, hi):
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
        part = np.unique([root(i) for i in range(len(line))], return_inverse=True)[1].reshape(-1)
        n = int(part.max()) + 1
        low, high, left, right = np.full(n, 1 << 62), np.full(n, -(1 << 62)), np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, part, line)
        np.maximum.at(high, part, line)
        np.minimum.at(left, part, x1)
        np.maximum.at(right, part, x2)
        column, row = key[3].as_py(), key[2].as_py()
        edges = {"left": x1 == column * tile_m, "right": x2 == (column + 1) * tile_m, "low": line == row * lines, "high": line == (row + 1) * lines - 1}
        at = {side: np.flatnonzero(hit) for side, hit in edges.items()}
        every = np.concatenate(list(at.values()))
        columns = {
            "part": np.concatenate((np.arange(n), part[every])).astype(np.int32),
            "side": ["all"] * n + [side for side, rows in at.items() for _ in rows],
            "line": np.concatenate((low, line[every])),
            "x1": np.concatenate((left, x1[every])),
            "x2": np.concatenate((right, x2[every])),
            "last": np.concatenate((high, line[every])),
            "length": np.concatenate((np.bincount(part, x2 - x1), np.zeros(len(every)))),
        }
        size = n + len(every)
        return _rows(columns | {name: [k.as_py()] * size for (name, _), k in zip(KEYS, key, strict=True)}, PARTS)

    return label


def regions(of: DataFrame, pitch: float = PITCH_M, tile_m: float = TILE_M) -> DataFrame:
    """Connected regions of maximal runs (floor keys, line, x1, x2) with area and
    extent. Runs of neighbouring lines join where they overlap."""
    lines = max(1, round(tile_m / pitch))
    tiles = by_column(of, tile_m).withColumn("row", F.floor(F.col("line") / lines))
    schema = "building_id long, ordinal int, row long, column long, part int, side string, line long, x1 double, x2 double, last long, length double"
    found = cut(tiles.select(*TILE, "line", "x1", "x2").groupBy(*TILE).applyInArrow(_labelled(tile_m, lines), schema))
    node = F.struct("row", "column", "part")
    border = lambda side, **move: found.where(F.col("side") == side).select(
        *FLOOR, "line", "column", "x1", "x2", node.alias("node")
    ).withColumns({k: F.col(k) + v for k, v in move.items()})
    ahead = border("right", column=1).select(*FLOOR, "line", "column", F.col("node").alias("a"))
    beside = ahead.join(border("left").withColumnRenamed("node", "b"), [*FLOOR, "line", "column"]).select(*FLOOR, "a", "b")
    below = border("high", line=1).select(*FLOOR, "line", "column", F.col("x1").alias("ax1"), F.col("x2").alias("ax2"), F.col("node").alias("a"))
    over = below.join(border("low").withColumnRenamed("node", "b"), [*FLOOR, "line", "column"]).where("x1 < ax2 and ax1 < x2")
    links = cut(beside.unionByName(over.select(*FLOOR, "a", "b")).distinct())
    whole = found.where("side = 'all'").withColumn("node", node)
    label = F.col("node")
    if not links.isEmpty():
        ends = links.select(*FLOOR, F.col("a").alias("node")).union(links.select(*FLOOR, "b")).distinct()
        whole = whole.join(components(ends, links, FLOOR), [*FLOOR, "node"], "left")
        label = F.coalesce("label", "node")
    return (
        whole.withColumn("region", label)
        .groupBy(*FLOOR, "region")
        .agg(
            (F.sum("length") * pitch).alias("area_m2"),
            F.min("x1").alias("x0"),
            F.max("x2").alias("x1"),
            (F.min("line") * pitch).alias("y0"),
            ((F.max("last") + 1) * pitch).alias("y1"),
        )
        .drop("region")
    )


def blind_regions(units, footprints, visibility, pitch: float = PITCH_M) -> DataFrame:
    """Connected blind regions per floor with area and extent."""
    return regions(runs(spans(units, footprints, visibility, pitch), False), pitch)


def boundary(of: DataFrame, tile_m: float) -> DataFrame:
    """Directed boundary edges (x, y, x2, y2, way) of maximal runs, y in lines;
    each edge has the region on its left."""
    up = lambda x, y, y2, way: F.struct(
        F.col(x).alias("x"), (F.col("line") + y).alias("y"), F.col(x).alias("x2"), (F.col("line") + y2).alias("y2"), F.lit(way).alias("way"),
        F.floor(F.col(x) / tile_m).alias("column"), F.col("line").alias("at"),
    )
    sides = of.select(*FLOOR, F.inline(F.array(up("x1", 1, 0, SOUTH), up("x2", 0, 1, NORTH))))
    step = lambda x, y, above, below: F.struct(
        F.col(x).alias("x"), (F.col("line") + y).alias("y"), F.lit(above).alias("above"), F.lit(below).alias("below")
    )
    steps = by_column(of, tile_m).select(
        *FLOOR, "column", F.inline(F.array(step("x1", 0, 1, 0), step("x2", 0, -1, 0), step("x1", 1, 0, 1), step("x2", 1, 0, -1)))
    )
    w = Window.partitionBy(*FLOOR, "y", "column").orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        steps.withColumns({"a": F.sum("above").over(upto), "b": F.sum("below").over(upto), "x2": F.lead("x").over(w)})
        .where("x2 > x and (a > 0) != (b > 0)")
    )
    east = F.col("a") > 0
    ends = lambda one, other: F.when(east, F.col(one)).otherwise(F.col(other))
    flat = pieces.select(
        *FLOOR, ends("x", "x2").alias("x"), "y", ends("x2", "x").alias("x2"), F.col("y").alias("y2"),
        F.when(east, EAST).otherwise(WEST).alias("way"), "column", F.col("y").alias("at"),
    )
    return sides.unionByName(flat)


def turn(come: int, go: int) -> int:
    """0 for a left turn, then straight on, then right: regions that touch in a
    corner keep outlines of their own."""
    return (come + 1 - go) % 4


CHAINS = [*KEYS, ("chain", pa.int32()), ("ring", pa.bool_()), ("start", pa.struct([("x", pa.float64()), ("y", pa.int64())])), ("go", pa.int32()),
          ("end", pa.struct([("x", pa.float64()), ("y", pa.int64())])), ("come", pa.int32()), ("twice", pa.float64()),
          ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.int64())])))]


def _strung(tile_m: float, lines: int):
    """Tile of boundary edges to closed rings and to chains that reach its border."""

    def string(key, tile):
        x, y, x2, y2, way = (tile[c].to_pylist() for c in ("x", "y", "x2", "y2", "way"))
        row, column = key[2].as_py(), key[3].as_py()

        def inner(px: float, py: int) -> bool:
            return column * tile_m < px < (column + 1) * tile_m and row * lines < py < (row + 1) * lines

        at: dict = {}
        for i, p in enumerate(zip(x, y, strict=True)):
            if inner(*p):
                at.setdefault(p, []).append(i)
        after = [min(at[p], key=lambda j, w=w: turn(w, way[j])) if (p := (a, b)) in at else -1 for a, b, w in zip(x2, y2, way, strict=True)]
        first = set(range(len(x))) - {j for j in after if j >= 0}
        left = set(range(len(x)))
        out: dict = {name: [] for name, _ in CHAINS}
        for start in [*sorted(first), *range(len(x))]:
            if start not in left:
                continue
            chain, i = [], start
            while i >= 0 and i in left:
                left.discard(i)
                chain.append(i)
                i = after[i]
            end = chain[-1]
            values = {
                "chain": len(out["chain"]), "ring": i == start, "start": {"x": x[start], "y": y[start]}, "go": way[start],
                "end": {"x": x2[end], "y": y2[end]}, "come": way[end],
                "twice": sum(x[j] * y2[j] - x2[j] * y[j] for j in chain),
                "points": [{"x": x[j], "y": y[j]} for n, j in enumerate(chain) if not n or way[j] != way[chain[n - 1]]],
            }
            for name, value in values.items():
                out[name].append(value)
        return _rows(out | {name: [k.as_py()] * len(out["chain"]) for (name, _), k in zip(KEYS, key, strict=True)}, CHAINS)

    return string


def ranked(chains: DataFrame) -> DataFrame:
    """Chains (floor keys, node, next) to (floor keys, node, leader, steps): the
    smallest chain of each cycle and how many steps lead to it. Both come by
    pointer doubling, so the rounds grow with the logarithm of a cycle."""
    two = lambda d, value: d.select(*FLOOR, F.col("node").alias("to"), F.col("to").alias("far"), F.col(value).alias("ahead"))
    state = cut(chains.select(*FLOOR, "node", F.col("next").alias("to"), F.least("node", "next").alias("leader")))
    while True:
        low = F.least("leader", "ahead")
        moved = state.join(two(state, "leader"), [*FLOOR, "to"]).select(*FLOOR, "node", F.col("far").alias("to"), low.alias("leader"), (low < F.col("leader")).alias("moved"))
        state = cut(moved)
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    at_leader = F.col("node") == F.col("leader")
    start = chains.join(state.select(*FLOOR, "node", "leader"), [*FLOOR, "node"])
    state = cut(start.select(*FLOOR, "node", "leader", F.when(at_leader, F.col("node")).otherwise(F.col("next")).alias("to"), F.when(at_leader, 0).otherwise(1).cast("long").alias("steps")))
    while not state.where("to != leader").isEmpty():
        state = cut(
            state.join(two(state, "steps"), [*FLOOR, "to"]).select(*FLOOR, "node", "leader", F.col("far").alias("to"), (F.col("steps") + F.col("ahead")).alias("steps"))
        )
    return state.select(*FLOOR, "node", "leader", "steps")


def outlines_of(of: DataFrame, pitch: float = PITCH_M, tile_m: float = TILE_M) -> DataFrame:
    """(floor keys, hole, area_m2, ring) of maximal runs: outer rings run
    counter-clockwise, holes clockwise, and their signed areas add up to the
    runs' area."""
    lines = max(1, round(tile_m / pitch))
    edges = boundary(of, tile_m).withColumn("row", F.floor(F.col("at") / lines))
    vertex = "struct<x:double,y:long>"
    schema = f"building_id long, ordinal int, row long, column long, chain int, ring boolean, start {vertex}, go int, end {vertex}, come int, twice double, points array<{vertex}>"
    found = cut(edges.select(*TILE, "x", "y", "x2", "y2", "way").groupBy(*TILE).applyInArrow(_strung(tile_m, lines), schema))
    closed = found.where("ring").select(*FLOOR, "twice", "points")
    open_ = found.where("not ring").withColumn("node", F.struct("row", "column", F.col("chain").alias("part")))
    if not open_.isEmpty():
        begin = open_.select(*FLOOR, F.col("start").alias("end"), "go", F.col("node").alias("next"))
        order = F.pmod(F.col("come") + 1 - F.col("go"), F.lit(4))
        links = cut(open_.select(*FLOOR, "end", "come", "node").join(begin, [*FLOOR, "end"]).groupBy(*FLOOR, "node").agg(F.min_by("next", order).alias("next")))
        order = ranked(links).withColumn("nth", F.when(F.col("steps") > 0, -F.col("steps")).otherwise(F.lit(-(1 << 62))))
        strung = open_.join(order, [*FLOOR, "node"]).groupBy(*FLOOR, "leader").agg(
            F.sum("twice").alias("twice"), F.array_sort(F.collect_list(F.struct("nth", "points"))).alias("parts")
        )
        closed = closed.unionByName(strung.select(*FLOOR, "twice", F.flatten("parts.points").alias("points")))

    def corner(p, i):
        n = F.size("points")
        a, b = F.get("points", F.pmod(i - 1, n)), F.get("points", F.pmod(i + 1, n))
        return ~(((a["x"] == p["x"]) & (p["x"] == b["x"])) | ((a["y"] == p["y"]) & (p["y"] == b["y"])))

    ring = F.transform(F.filter("points", corner), lambda p: F.struct(p["x"].alias("x"), (p["y"] * F.lit(pitch)).alias("y")))
    return closed.select(*FLOOR, (F.col("twice") < 0).alias("hole"), (F.abs("twice") * (pitch / 2)).alias("area_m2"), ring.alias("ring"))


def outlines(units, footprints, visibility, pitch: float = PITCH_M) -> DataFrame:
    """Covered and blind outlines of every floor: (floor keys, kind, hole,
    area_m2, ring)."""
    elementary = cut(spans(units, footprints, visibility, pitch))
    each = [outlines_of(runs(elementary, kind == "covered"), pitch).withColumn("kind", F.lit(kind)) for kind in ("covered", "blind")]
    return each[0].unionByName(each[1]).select(*FLOOR, "kind", "hole", "area_m2", "ring")
