"""Wall segments that block sight, per floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g
from .spatial import FLOOR

WALK_UNDER_M = 1.8


def _edges(df: DataFrame, source: str, key: str) -> DataFrame:
    e = df.select(
        *FLOOR,
        F.lit(source).alias("source"),
        F.col(key).cast("string").alias("source_id"),
        F.explode(g.ring_edges(F.col("polygon"))).alias("e"),
    )
    return e.select(
        *FLOOR,
        "source",
        "source_id",
        F.col("e.i").alias("pos"),
        g.pt(F.col("e.ax"), F.col("e.ay")).alias("a"),
        g.pt(F.col("e.bx"), F.col("e.by")).alias("b"),
    )


def has_area(ring: str = "polygon"):
    return (F.size(ring) >= 3) & (g.polygon_area(F.col(ring)) >= 1e-6)


def first_footprints(footprints: DataFrame) -> DataFrame:
    """The first usable outline of each floor."""
    return (
        footprints.where(F.size("polygon") >= 3)
        .groupBy(*FLOOR)
        .agg(F.min_by("polygon", "pos").alias("polygon"))
    )


def walls(units: DataFrame, footprints: DataFrame, structures: DataFrame | None) -> DataFrame:
    """Edges of units, of the floor outline, and of structures too low to see
    under. Doors stay closed: a unit outline blocks sight all round."""
    out = _edges(units.where(has_area()), "unit", "unit_id").unionByName(
        _edges(first_footprints(footprints), "footprint", "ordinal")
    )
    if structures is not None:
        low = structures.where((F.coalesce("base_m", F.lit(0.0)) < WALK_UNDER_M) & has_area())
        out = out.unionByName(_edges(low, "structure", "structure_id"))
    return out


def distinct_segments(w: DataFrame) -> DataFrame:
    """Party walls appear once per room; keep each undirected segment once,
    with how many source walls it stands for."""
    return (
        w.select(*FLOOR, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .groupBy(*FLOOR, "a", "b")
        .agg(F.count("*").alias("copies"))
    )


def floor_stats(segments: DataFrame) -> DataFrame:
    """Per floor: source wall count and extent of the walls."""
    return segments.groupBy(*FLOOR).agg(
        F.sum("copies").alias("n_walls"),
        F.struct(
            F.min(F.least("a.x", "b.x")).alias("x0"),
            F.min(F.least("a.y", "b.y")).alias("y0"),
            F.max(F.greatest("a.x", "b.x")).alias("x1"),
            F.max(F.greatest("a.y", "b.y")).alias("y1"),
        ).alias("extent"),
    )
