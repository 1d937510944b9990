"""Covered and blind area per floor, by scanline integration.

Rings are cut by horizontal scanlines one `pitch` apart. On each line a ring
leaves intervals; the length where at least one camera interval lies over the
floor, times the pitch, sums to the covered area. Lines are also cut into
column tiles, so a single crowded floor still spreads over many tasks, and
lengths add up by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as g, sight
from ..session import cut
from .spatial import FLOOR, points_in_boxes, with_box
from .walls import first_footprints, has_area

COLUMN_M = 64.0
# One scanline pitch for areas and regions, so that they agree.
PITCH_M = 0.25
GRID_M = 1.25


def floor_shapes(units: DataFrame, footprints: DataFrame) -> DataFrame:
    """Floor extent: the footprint, or every unit where there is none."""
    fp = first_footprints(footprints)
    loose = units.where(has_area()).join(fp.select(*FLOOR), FLOOR, "left_anti")
    return fp.select(*FLOOR, F.lit("footprint").alias("shape_id"), "polygon").unionByName(
        loose.select(*FLOOR, F.col("unit_id").alias("shape_id"), "polygon")
    )


def intervals(shapes: DataFrame, pitch: float, tag: str) -> DataFrame:
    """Inside intervals of each ring on each scanline (even-odd)."""
    box = g.bbox(F.col("polygon"))
    at = lambda y: F.ceil(y / pitch - 0.5)
    lines = shapes.withColumns({"lo": at(box["y0"]), "hi": at(box["y1"]) - 1}).where("lo <= hi")
    bands = F.sequence(F.floor(F.col("lo") / sight.BAND), F.floor(F.col("hi") / sight.BAND))
    runs = (
        lines.select(*FLOOR, "polygon", F.explode(bands).alias("band"))
        .select(*FLOOR, F.inline(sight.line_runs(F.col("polygon"), F.col("band"), pitch)))
        .withColumnsRenamed({"x1": "x"})
    )
    c = F.col("column")
    return runs.withColumn(
        "column",
        F.explode(F.sequence(F.floor(F.col("x") / COLUMN_M), F.floor(F.col("x2") / COLUMN_M))),
    ).select(
        *FLOOR,
        "line",
        "column",
        F.greatest("x", c * COLUMN_M).alias("x1"),
        F.least("x2", (c + 1) * COLUMN_M).alias("x2"),
        F.lit(tag).alias("tag"),
    )


def spans(units, footprints, visibility, pitch: float) -> DataFrame:
    """Elementary spans of every scanline with their floor and camera counts.
    Rings are cut into intervals where they lie; the ends of a line meet once, and
    between ends at one place no span is left."""
    rings = visibility.where(F.size("ring") >= 3).select(
        *FLOOR, F.col("camera_id").alias("shape_id"), F.col("ring").alias("polygon")
    )
    iv = intervals(floor_shapes(units, footprints), pitch, "floor").unionByName(
        intervals(rings, pitch, "camera")
    )
    is_floor = F.col("tag") == "floor"
    ends = (
        iv.withColumns(
            {
                "df": F.when(is_floor, 1).otherwise(0),
                "dc": F.when(is_floor, 0).otherwise(1),
            }
        )
        .select(
            *FLOOR,
            "line",
            "column",
            F.inline(
                F.array(
                    F.struct(F.col("x1").alias("x"), F.col("df").alias("df"), F.col("dc").alias("dc")),
                    F.struct(F.col("x2").alias("x"), (-F.col("df")).alias("df"), (-F.col("dc")).alias("dc")),
                )
            ),
        )
    )
    w = Window.partitionBy(*FLOOR, "line", "column").orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        ends.withColumns(
            {
                "on_floor": F.sum("df").over(run) > 0,
                "cameras": F.sum("dc").over(run),
                "x2": F.lead("x").over(w),
            }
        )
        .where("x2 > x and on_floor")
        .select(*FLOOR, "line", F.col("x").alias("x1"), "x2", "cameras")
    )


def coverage(units, footprints, visibility, pitch: float = PITCH_M) -> DataFrame:
    """Floor, covered and blind area (m2) and the covered share per floor."""
    length = F.col("x2") - F.col("x1")
    return (
        spans(units, footprints, visibility, pitch)
        .groupBy(*FLOOR)
        .agg(
            (F.sum(length) * pitch).alias("floor_m2"),
            (F.sum(F.when(F.col("cameras") > 0, length).otherwise(0.0)) * pitch).alias("covered_m2"),
        )
        .withColumn("blind_m2", F.greatest(F.lit(0.0), F.col("floor_m2") - F.col("covered_m2")))
        .withColumn(
            "coverage_pct",
            F.when(
                F.col("floor_m2") > 0,
                F.col("covered_m2") / F.when(F.col("floor_m2") > 0, F.col("floor_m2")),
            ).otherwise(0.0),
        )
    )


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]):
    """Connected components by smallest label, with pointer jumping.

    nodes: keys + node; edges: keys + a, b (either direction). Each round takes
    the smallest label among neighbours, then the label of that label; rounds
    grow with the logarithm of the longest chain in practice, and go on until
    no label moves. Lineage is cut each round in the reliable checkpoint folder.
    """
    both = cut(
        edges.select(*keys, "a", "b").unionByName(
            edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
        )
    )
    labels = cut(nodes.select(*keys, "node", F.col("node").alias("label")))
    while True:
        seen = (
            both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node"))
            .agg(F.min("label").alias("low"))
        )
        near = labels.join(seen, [*keys, "node"], "left").select(
            *keys, "node", "label", F.least("label", F.coalesce("low", "label")).alias("next")
        )
        jump = labels.select(*keys, F.col("node").alias("next"), F.col("label").alias("far"))
        stepped = cut(
            near.join(jump, [*keys, "next"], "left").select(
                *keys, "node", F.least("next", F.coalesce("far", "next")).alias("label"),
                (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved"),
            )
        )
        moved = stepped.where("moved").limit(1).count()
        labels = stepped.drop("moved")
        if not moved:
            return labels


def grid_cells(shapes: DataFrame, pitch=GRID_M, offset=None) -> DataFrame:
    """Cell centres inside each floor, `pitch` apart: one number on floors of any
    size, or an aggregate of a floor's shapes."""
    step = pitch if isinstance(pitch, Column) else F.max(F.lit(float(pitch)))
    box = g.bbox(F.col("polygon"))
    floor = shapes.groupBy(*FLOOR).agg(
        step.alias("pitch"),
        F.min(box["x0"]).alias("gx0"), F.min(box["y0"]).alias("gy0"),
        F.max(box["x1"]).alias("gx1"), F.max(box["y1"]).alias("gy1"),
    )
    # Few bytes of floors become many cells, so the tasks are spread beforehand.
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floor = floor.repartition(tasks, *FLOOR)
    p = F.col("pitch")
    off = p / 2 if offset is None else F.lit(float(offset))
    count = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo) - off) / p), F.lit(0))
    cells = (
        floor.withColumns({"nx": count("gx0", "gx1"), "ny": count("gy0", "gy1")})
        .where("nx > 0 and ny > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
        .select(
            *FLOOR, "pitch", "i", "j",
            (F.col("i") * F.col("ny") + F.col("j")).alias("cell"),
            g.pt(F.col("gx0") + off + F.col("i") * p, F.col("gy0") + off + F.col("j") * p).alias("at"),
        )
    )
    boxes = with_box(shapes.select(*FLOOR, "polygon"))
    return (
        points_in_boxes(cells, boxes, "cell")
        .where(sight.ring_holds(F.col("at"), F.col("polygon")))
        .drop("polygon")
        .dropDuplicates([*FLOOR, "cell"])
    )


def cover_counts(cells: DataFrame, visibility: DataFrame) -> DataFrame:
    """How many cameras see each grid cell (zero included)."""
    rings = visibility.where(F.size("ring") >= 3).select(
        *FLOOR, "ring", g.bbox(F.col("ring")).alias("box")
    )
    seen = (
        points_in_boxes(cells.select(*FLOOR, "cell", "at"), rings, "cell")
        .where(sight.ring_holds(F.col("at"), F.col("ring")))
        .groupBy(*FLOOR, "cell")
        .agg(F.count("*").alias("cameras"))
    )
    return cells.join(seen, [*FLOOR, "cell"], "left").fillna(0, ["cameras"])


def grid_coverage(units, footprints, visibility, pitch: float = GRID_M) -> DataFrame:
    cells = grid_cells(floor_shapes(units, footprints), pitch)
    return (
        cover_counts(cells, visibility)
        .groupBy(*FLOOR)
        .agg(
            F.count("*").alias("cells"),
            F.count_if(F.col("cameras") > 0).alias("covered"),
            F.count_if(F.col("cameras") > 1).alias("redundant"),
        )
    )
