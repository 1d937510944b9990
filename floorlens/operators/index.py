"""Space-to-camera index: which cameras see each space, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g, labels, optics, sight
from .probe import see
from .spatial import FLOOR, box_join, rank_scores

UNIT = [*FLOOR, "unit_id"]


def indexable(category: Column) -> Column:
    return ~category.isin("corridor", "outside")


def unit_samples(units: DataFrame, step: float = 8.0) -> DataFrame:
    s = units.where(indexable(F.col("category"))).select(
        *UNIT, F.posexplode(g.sample_points(F.col("polygon"), step)).alias("sample", "at")
    )
    return s.withColumn("sample_id", F.concat_ws("#", "unit_id", "sample"))


def unit_scores(units, cameras, visibility) -> DataFrame:
    """Best score of every camera over the sample points of every space; read
    by unit it is "seen by", read by camera it is "spaces in view"."""
    seen = see(unit_samples(units), cameras, visibility, "sample_id")
    return seen.groupBy(*UNIT, "camera_id", "cam_pos").agg(F.max("score").alias("score"))


def camera_index(units, cameras, visibility) -> DataFrame:
    """One row per (space, camera) with its rank; gaps keep one null row."""
    ranked = rank_scores(unit_scores(units, cameras, visibility), UNIT, "score", ["cam_pos"])
    info = cameras.select(
        "building_id", "camera_id", F.col("name").alias("camera_name"),
        F.col("kind").alias("camera_kind"), "stream_ref",
    )
    spaces = units.where(indexable(F.col("category"))).select(
        *UNIT, "name", "category", labels.security_of(F.col("security")).alias("security")
    )
    return spaces.join(ranked, UNIT, "left").join(info, ["building_id", "camera_id"], "left")


def unit_camera_counts(units, cameras, visibility) -> DataFrame:
    n = unit_scores(units, cameras, visibility).groupBy(*UNIT).agg(F.count("*").alias("cameras"))
    return (
        units.where(indexable(F.col("category")))
        .select(*UNIT, "name", "category", labels.security_of(F.col("security")).alias("security"))
        .join(n, UNIT, "left")
        .fillna(0, ["cameras"])
        .withColumn("is_gap", F.col("cameras") == 0)
        .withColumn("is_redundant", F.col("cameras") >= 2)
        .withColumn(
            "secure_under_covered",
            F.col("security").isin("secure", "restricted") & (F.col("cameras") < 2),
        )
    )


def index_stats(counts: DataFrame) -> DataFrame:
    """Per building: spaces, gaps, redundantly covered and secure spaces seen
    by fewer than two cameras. The named spaces stay rows of `counts`."""
    return counts.groupBy("building_id").agg(
        F.count("*").alias("spaces"),
        F.count_if("is_gap").alias("gaps"),
        F.count_if("is_redundant").alias("redundant"),
        F.count_if("secure_under_covered").alias("secure_under_covered"),
    )


def camera_unit_overlap(units: DataFrame, visibility: DataFrame) -> DataFrame:
    """Camera-space pairs whose ring and outline share area."""
    v = visibility.where(F.size("ring") >= 3).select(
        *FLOOR, "camera_id", "ring", g.bbox(F.col("ring")).alias("lbox")
    )
    u = units.where(F.size("polygon") >= 3).select(
        *FLOOR, "unit_id", "polygon", g.bbox(F.col("polygon")).alias("rbox")
    )
    return (
        box_join(v, u)
        .where(sight.rings_overlap(F.col("ring"), F.col("polygon")))
        .select(*FLOOR, "camera_id", "unit_id")
    )


def dori(cameras: DataFrame) -> DataFrame:
    """Pixel density ranges of each camera; 0 = unrated."""
    k, fov, mp = F.col("kind"), F.col("fov_deg"), F.col("resolution_mp")
    px = optics.px_per_metre(k, fov, mp, F.col("range_m"))
    return cameras.select(
        *FLOOR, "camera_id",
        *[optics.dori_range_m(k, fov, mp, b).alias(f"{b}_m") for b in optics.DORI_PX],
        px.alias("px_at_range"),
        optics.dori_band(px).alias("band_at_range"),
    )
