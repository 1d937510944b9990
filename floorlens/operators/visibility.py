"""Occlusion-clipped visibility ring of every camera.

1. camera x wall candidates from a tile join, culled to the range disc and the
   sector in view;
2. the walls of a camera are shuffled once, as they are, each with the direction
   sectors it lies in; rays (a coarse arc, plus three per wall corner) are made
   beside them and keep their nearest hit (``functions.rays``);
3. ray ends in angle order are the ring of the camera.

The number of direction sectors grows with the walls expected around the
camera, and rays meet the walls of their own sector only, so the ray-wall pairs
stay proportional to the walls instead of to their square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g, optics, rays
from ..session import cut
from .spatial import FLOOR, box_join
from .walls import distinct_segments, floor_stats

CAMERA = [*FLOOR, "camera_id"]
WALLS_PER_SECTOR = 128


def poses(cameras: DataFrame, stats: DataFrame) -> DataFrame:
    """Camera pose in the terms the ray caster needs, with the extent of the
    floor's walls and the number of direction sectors."""
    kind, fov = F.col("kind"), F.col("fov_deg")
    band = optics.tilt_band(kind, fov, F.col("tilt_deg"), F.col("mount_m"), F.col("vfov_deg"))
    reach = F.least(F.col("range_m"), F.coalesce(band["far_m"], F.col("range_m")))
    cams = cameras.select(
        *CAMERA,
        F.struct(
            F.col("at.x").alias("x"),
            F.col("at.y").alias("y"),
            F.radians("heading").alias("h"),
            optics.is_full(kind, fov).alias("full"),
            optics.half_fov(kind, fov).alias("half"),
            reach.alias("r"),
            F.least(F.coalesce(band["near_m"], F.lit(0.0)), reach).alias("near"),
        ).alias("cam"),
    )
    e, r = F.col("extent"), F.col("cam.r")
    side = lambda lo, hi: F.least(F.lit(1.0), (r * 2 + 1) / (hi - lo + 1))
    expected = F.col("n_walls") * side(e["x0"], e["x1"]) * side(e["y0"], e["y1"])
    doublings = F.greatest(
        F.lit(0.0), F.ceil(F.log2(F.coalesce(expected, F.lit(1.0)) / WALLS_PER_SECTOR))
    )
    return cams.join(stats, FLOOR, "left").withColumn(
        "sectors", F.pow(F.lit(2.0), doublings).cast("int")
    )


def _local_walls(cams: DataFrame, segments: DataFrame) -> DataFrame:
    """(camera, wall) pairs within range and view, with the distance."""
    c, e = F.col("cam"), F.col("extent")
    reach = c["r"] + 0.01
    boxed = cams.where("n_walls is not null").withColumn(
        "lbox",
        F.struct(
            F.greatest(c["x"] - reach, e["x0"]).alias("x0"),
            F.greatest(c["y"] - reach, e["y0"]).alias("y0"),
            F.least(c["x"] + reach, e["x1"]).alias("x1"),
            F.least(c["y"] + reach, e["y1"]).alias("y1"),
        ),
    )
    a, b = F.col("a"), F.col("b")
    walls = segments.select(
        *FLOOR,
        "a",
        "b",
        F.struct(
            F.least(a["x"], b["x"]).alias("x0"),
            F.least(a["y"], b["y"]).alias("y0"),
            F.greatest(a["x"], b["x"]).alias("x1"),
            F.greatest(a["y"], b["y"]).alias("y1"),
        ).alias("rbox"),
    )
    return (
        box_join(boxed.drop("extent"), walls)
        .withColumn("gap", rays.gap(c, reach, a, b))
        .where("gap is not null")
        .select(*CAMERA, "cam", "sectors", "a", "b", "gap")
    )


def _sector(theta, n):
    return F.floor((theta + math.pi) / (2 * math.pi) * n).cast("int")


def _sector_walls(local: DataFrame) -> DataFrame:
    """Each local wall, once per direction sector in which it lies or a ray at
    its corners goes."""
    c, n = F.col("cam"), F.col("sectors")
    towards = lambda e: F.atan2(F.col(f"{e}.y") - c["y"], F.col(f"{e}.x") - c["x"])
    turn = g.wrap_pi(towards("b") - towards("a"))
    start = F.when(turn >= 0, towards("a")).otherwise(towards("b"))
    pad = 2 * rays.EPS_RAD
    span = F.sequence(_sector(start - pad, n), _sector(start + F.abs(turn) + pad, n))
    span = F.array_distinct(F.transform(span, lambda k: F.pmod(k, n)))
    sectors = F.when(n == 1, F.array(F.lit(0))).when(F.col("gap") < 1e-6, F.sequence(F.lit(0), n - 1)).otherwise(span)
    return local.select(
        *CAMERA, "cam", "sectors", F.explode(sectors).alias("sector"),
        F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"),
    ).select(*CAMERA, "cam", "sectors", F.struct("sector", "ax", "ay", "bx", "by").alias("wall"))


def _arc(c) -> Column:
    """Rays in steps of an arc over the view."""
    n = F.greatest(
        F.lit(1), F.ceil(c["half"] * 2 / math.radians(optics.ARC_STEP_DEG)).cast("int")
    )

    def ray(i):
        rel = -c["half"] + c["half"] * 2 * i / n
        return F.struct(rel.alias("rel"), F.cos(c["h"] + rel).alias("ux"), F.sin(c["h"] + rel).alias("uy"))

    return F.transform(F.sequence(F.lit(0), F.when(c["full"], n - 1).otherwise(n)), ray)


def _hits(cameras: DataFrame, walls: DataFrame) -> DataFrame:
    """Per camera: its rays, each with the distance where it stops. Wall
    segments and poses are materialised, since both are read twice."""
    segments = cut(distinct_segments(walls))
    cams = cut(poses(cameras, floor_stats(segments)))
    c = F.col("cam")
    rel = lambda w, e: g.wrap_pi(F.atan2(w[f"{e}y"] - c["y"], w[f"{e}x"] - c["x"]) - c["h"])
    ends = F.transform("walls", lambda w: F.struct(rel(w, "a").alias("a"), rel(w, "b").alias("b")))
    return (
        cams.select(*CAMERA, "cam", "sectors")
        .unionByName(_sector_walls(_local_walls(cams, segments)), allowMissingColumns=True)
        .groupBy(*CAMERA, "cam", "sectors")
        .agg(F.collect_list("wall").alias("walls"))
        .select(*CAMERA, "cam", rays.stops(c, F.col("sectors"), _arc(c), F.col("walls"), ends).alias("hits"))
    )


def ray_hits(cameras: DataFrame, walls: DataFrame) -> DataFrame:
    """Every ray (offset from the heading, unit direction) and where it stops."""
    return _hits(cameras, walls).select(*CAMERA, F.inline("hits"))


def visibility(cameras: DataFrame, walls: DataFrame) -> DataFrame:
    """(building_id, ordinal, camera_id, ring): a star ring for all-round
    cameras, apex + fan for the rest, an annular band for tilted ones."""
    hits = _hits(cameras, walls).withColumn("hits", F.array_sort("hits")).withColumn(
        "hits",
        F.filter(
            "hits",
            lambda s, i: (i == 0)
            | F.coalesce(s["rel"] != F.get(F.col("hits"), i - 1)["rel"], F.lit(True)),
        ),
    )
    c = F.col("cam")
    end = lambda s, d: g.pt(c["x"] + s["ux"] * d, c["y"] + s["uy"] * d)
    outer = F.transform("hits", lambda s: end(s, s["dist"]))
    inner = F.reverse(
        F.transform("hits", lambda s: end(s, F.least(c["near"], s["dist"] * 0.999)))
    )
    ring = (
        F.when(c["full"], outer)
        .when(c["near"] > 0.3, F.concat(outer, inner))
        .otherwise(F.concat(F.array(g.pt(c["x"], c["y"])), outer))
    )
    return hits.select(*CAMERA, ring.alias("ring"))
