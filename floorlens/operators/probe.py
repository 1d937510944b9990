"""Which cameras see a point, and how well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g, optics, sight
from .spatial import FLOOR, points_in_boxes
from .visibility import CAMERA

# Weight of aim, nearness and depth inside the view.
VIEW_WEIGHTS = {"heading": 0.45, "distance": 0.35, "depth": 0.2}
ALL_ROUND_AIM = 0.62
DEPTH_FULL_M = 6.0


def _candidates(points: DataFrame, cameras: DataFrame, point_id: str) -> DataFrame:
    """Point-camera pairs inside range and sector, before walls are looked at."""
    r = F.col("range_m")
    cams = cameras.select(
        *CAMERA,
        F.col("pos").alias("cam_pos"),
        F.struct("at.x", "at.y", "heading", "fov_deg", "kind", "range_m").alias("view"),
        F.struct(
            (F.col("at.x") - r).alias("x0"),
            (F.col("at.y") - r).alias("y0"),
            (F.col("at.x") + r).alias("x1"),
            (F.col("at.y") + r).alias("y1"),
        ).alias("box"),
    )
    v = F.col("view")
    dx, dy = F.col("at.x") - v["x"], F.col("at.y") - v["y"]
    full = optics.is_full(v["kind"], v["fov_deg"])
    half = optics.half_fov(v["kind"], v["fov_deg"])
    off = F.abs(g.wrap_pi(F.atan2(dy, dx) - F.radians(v["heading"])))
    return (
        points_in_boxes(points, cams, point_id)
        .withColumn("distance_m", g.hypot(dx, dy))
        .where(F.col("distance_m") <= v["range_m"] + 1e-6)
        .withColumn("off", off)
        .where(full | (F.col("off") <= half + 3e-4))
        .withColumn(
            "heading_align",
            F.when(full, F.lit(ALL_ROUND_AIM)).otherwise(
                1 - F.least(F.col("off") / F.greatest(half, F.lit(1e-6)), F.lit(1.0))
            ),
        )
        .drop("off")
    )


def see(
    points: DataFrame, cameras: DataFrame, visibility: DataFrame, point_id: str = "probe_id"
) -> DataFrame:
    """Every (point, camera) whose ring contains the point, with its score.

    `points` needs the floor keys, `point_id` and `at`.
    """
    rings = visibility.where(F.size("ring") >= 3).select(
        *CAMERA, "ring"
    )
    reach = F.greatest(F.col("view.range_m"), F.lit(1e-6))
    score = (
        F.col("heading_align") * VIEW_WEIGHTS["heading"]
        + (1 - F.least(F.col("distance_m") / reach, F.lit(1.0))) * VIEW_WEIGHTS["distance"]
        + F.least(F.col("depth_m") / DEPTH_FULL_M, F.lit(1.0)) * VIEW_WEIGHTS["depth"]
    )
    return (
        _candidates(points, cameras, point_id)
        .join(rings, CAMERA)
        .withColumn("depth_m", sight.ring_depth(F.col("at"), F.col("ring")))
        .where("depth_m is not null")
        .withColumn("score", score)
        .drop("ring", "view")
    )


def rank_cameras(
    points: DataFrame, cameras: DataFrame, visibility: DataFrame, point_id: str = "probe_id",
    top: int | None = None,
) -> DataFrame:
    """Best view first per point. Every row is ranked; with `top` only that
    page is kept, and Spark limits each group before the shuffle. A point is seen
    by the cameras around it alone, so one window over a point suffices."""
    seen = see(points, cameras, visibility, point_id)
    w = Window.partitionBy(*FLOOR, point_id).orderBy(F.desc("score"), "cam_pos")
    ranked = seen.withColumn("rank", F.row_number().over(w).cast("long" if top is None else "int"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
