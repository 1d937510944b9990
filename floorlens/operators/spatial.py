"""Partitioned spatial joins, hot-key splitting and exact numbering.

Every spatial join is an equi-join on (building, floor, tile): boxes are
exploded to the tiles they touch, points fall in one tile. A floor that holds a
large share of the data therefore spreads over its tiles, and tiles that are
still hot are split by `split_hot`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g

FLOOR = ["building_id", "ordinal"]
TILE_M = 16.0


def tile(v: Column, size: float = TILE_M) -> Column:
    return F.floor(v / F.lit(size)).cast("int")


def with_box(df: DataFrame, ring: str = "polygon", name: str = "box") -> DataFrame:
    return df.withColumn(name, g.bbox(F.col(ring)))


def point_tiles(df: DataFrame, at: str = "at", size: float = TILE_M) -> DataFrame:
    return df.withColumns(
        {"tx": tile(F.col(at)["x"], size), "ty": tile(F.col(at)["y"], size)}
    )


def box_tiles(df: DataFrame, box: str = "box", size: float = TILE_M, pad: float = 0.0):
    """One row per tile the box touches; tx0/ty0 keep its lowest tile."""
    b = F.col(box)
    lo = lambda v: tile(b[v] - pad, size)
    hi = lambda v: tile(b[v] + pad, size)
    return (
        df.where((b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]))
        .withColumns({"tx0": lo("x0"), "ty0": lo("y0")})
        .withColumn("tx", F.explode(F.sequence("tx0", hi("x1"))))
        .withColumn("ty", F.explode(F.sequence("ty0", hi("y1"))))
    )


def box_join(left: DataFrame, right: DataFrame, size: float = TILE_M) -> DataFrame:
    """Inner join of boxes that meet on the same floor, each pair once.

    `left` carries struct column `lbox`, `right` carries `rbox`; other column
    names must differ apart from the floor keys. A pair that shares several
    tiles is kept only in the lowest tile common to both.
    """
    a = box_tiles(left, "lbox", size).withColumnsRenamed({"tx0": "lx0", "ty0": "ly0"})
    b = box_tiles(right, "rbox", size).withColumnsRenamed({"tx0": "rx0", "ty0": "ry0"})
    lb, rb = F.col("lbox"), F.col("rbox")
    meet = (
        (lb["x0"] <= rb["x1"])
        & (rb["x0"] <= lb["x1"])
        & (lb["y0"] <= rb["y1"])
        & (rb["y0"] <= lb["y1"])
    )
    once = (F.col("tx") == F.greatest("lx0", "rx0")) & (F.col("ty") == F.greatest("ly0", "ry0"))
    return (
        a.join(b.hint("merge"), [*FLOOR, "tx", "ty"])
        .where(once & meet)
        .drop("tx", "ty", "lx0", "ly0", "rx0", "ry0")
    )


def split_hot(
    left: DataFrame, right: DataFrame, keys: list[str], salt_on: str, rows: int = 1_000_000
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Spread keys with more than `rows` left rows over several tasks.

    Left rows of a hot key get one of ceil(n / rows) salts; right rows of that
    key are repeated per salt. The table of hot keys has at most |left| / rows
    entries. Returns both sides and the widened key list.
    """
    hot = (
        left.groupBy(*keys)
        .count()
        .where(F.col("count") > rows)
        .select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("salts"))
    )
    n = F.coalesce("salts", F.lit(1))
    a = (
        left.join(hot, keys, "left")
        .withColumn("salt", F.pmod(F.xxhash64(salt_on), n).cast("int"))
        .drop("salts")
    )
    b = (
        right.join(hot, keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
        .drop("salts")
    )
    return a, b, [*keys, "salt"]


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, salt_on: str, at: str = "at", size: float = TILE_M,
    rows: int = 1_000_000,
) -> DataFrame:
    """Candidate join of points to same-floor boxes that contain them.

    `boxes` carries struct column `box`; column names other than the floor keys
    must differ from those of `points`. Both sides may come out of an explode,
    whose rows Spark's estimate of their size does not count, so neither is
    broadcast.
    """
    p, b = point_tiles(points, at, size), box_tiles(boxes, "box", size).drop("tx0", "ty0")
    a, b, keys = split_hot(p, b, [*FLOOR, "tx", "ty"], salt_on, rows)
    x, y, box = F.col(at)["x"], F.col(at)["y"], F.col("box")
    inside = (x >= box["x0"]) & (x <= box["x1"]) & (y >= box["y0"]) & (y <= box["y1"])
    return a.join(b.hint("merge"), keys).where(inside).drop("tx", "ty", "salt", "box")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: filters and later columns
    take their values, where Spark would else put the whole expression in the
    place of each mention."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def number_rows(
    df: DataFrame, keys: list[str], pos: str, name: str = "n", bucket: int = 500_000,
    ties: list[str] | None = None,
) -> DataFrame:
    """Exact 1-based numbering by `pos` within `keys`, without one task per key.

    Rows are cut into ranges of `bucket` positions; range counts (a small
    table) give each range its offset and a window numbers rows inside it.
    """
    b = F.floor(F.col(pos) / bucket)
    return _number(df, keys, b, [F.col(pos), *[F.col(t) for t in ties or []]], name)


def rank_scores(
    df: DataFrame, keys: list[str], score: str, ties: list[str], name: str = "rank",
    buckets: int = 64,
) -> DataFrame:
    """Exact 1-based rank, best score first, for scores in 0..1; a hot key is
    worked on as `buckets` score bands rather than as one group."""
    s = F.col(score)
    band = F.floor((F.lit(1.0) - s) * buckets)
    return _number(df, keys, band, [s.desc(), *[F.col(t) for t in ties]], name)


def _number(df, keys, bucket: Column, order: list[Column], name: str) -> DataFrame:
    d = df.withColumn("_b", bucket)
    part = [*keys, "_b"]
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*part)
        .count()
        .withColumn("_off", F.coalesce(F.sum("count").over(w), F.lit(0)))
        .drop("count")
    )
    own = Window.partitionBy(*part).orderBy(*order)
    return (
        d.withColumn("_r", F.row_number().over(own))
        .join(offsets, part)
        .withColumn(name, (F.col("_off") + F.col("_r")).cast("bigint"))
        .drop("_b", "_r", "_off")
    )
