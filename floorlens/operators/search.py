"""Search panels and the tenant directory, over all buildings at once.

A page (`top`) keeps the first rows of each building in array order and tells
how many there are; without it all matches are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import labels
from .places import occupant_names, vacant_units
from .spatial import FLOOR


def paged(found: DataFrame, keys: list[str], order: str, top: int | None) -> DataFrame:
    """Adds `matches`, the rows of the same keys, and keeps the first `top`."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("matches"))
    if top is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        found = found.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
    return found.join(counts, keys)


def spaces(units: DataFrame, occupants: DataFrame, text: str) -> DataFrame:
    """Spaces whose name, category or tenants contain the text."""
    named = units.where(labels.is_space(F.col("category"))).join(occupant_names(occupants), ["building_id", "unit_id"], "left")
    return named.where(labels.contains_text(text, F.col("name"), F.col("category"), F.col("names")))


def cameras(cameras: DataFrame, text: str, kind: str | None = None, ordinal: int | None = None, top: int | None = None) -> DataFrame:
    """Cameras of a kind (any if None) and floor (all if None) by name."""
    found = cameras.where(labels.contains_text(text, F.col("name")))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if ordinal is not None:
        found = found.where(F.col("ordinal") == ordinal)
    return paged(found, ["building_id"], "pos", top)


def addable_cameras(cameras: DataFrame, views: DataFrame, text: str, top: int | None = None) -> DataFrame:
    """Cameras in none of the given views, by name or by the start of their
    call-up number; pages are per floor."""
    used = views.select("building_id", F.explode("camera_ids").alias("camera_id"))
    needle = text.strip().lower()
    number = F.coalesce(F.col("op_number").cast("string"), F.lit("")).startswith(needle)
    hit = labels.contains_text(text, F.col("name")) | (number if needle else F.lit(True))
    return paged(cameras.where(hit).join(used, ["building_id", "camera_id"], "left_anti"), FLOOR, "pos", top)


def amenities(amenities: DataFrame, text: str, kind: str | None = None, top: int | None = None) -> DataFrame:
    """Points of interest of a kind (any if None) by name or kind."""
    found = amenities.where(labels.contains_text(text, F.col("name"), F.col("kind")))
    return paged(found if kind is None else found.where(F.col("kind") == kind), ["building_id"], "pos", top)


def amenity_kinds(amenities: DataFrame) -> DataFrame:
    return amenities.select("building_id", "kind").distinct()


def directory(occupants: DataFrame, units: DataFrame) -> DataFrame:
    """Tenants by category and, as category `vacant`, the spaces without one:
    (building_id, category, tenants, units)."""
    let = occupants.groupBy("building_id", "category").agg(F.count("*").alias("tenants"), F.countDistinct("unit_id").alias("units"))
    free = vacant_units(units, occupants).where("category != 'outside'").groupBy("building_id").agg(F.count("*").alias("units"))
    return let.unionByName(free.select("building_id", F.lit("vacant").alias("category"), F.lit(0).cast("long").alias("tenants"), "units"))


def lit_cameras(nearest: DataFrame, point_id: str, selected: DataFrame, most: int = 9) -> DataFrame:
    """Ranked cameras around a point (`rank` 1, 2, ...) with the point's selected
    camera (floor keys, point_id, camera_id) first, each once, `most` at most."""
    first = selected.select(*FLOOR, point_id, "camera_id", F.lit(0).alias("rank"))
    every = first.unionByName(nearest.select(*FLOOR, point_id, "camera_id", F.col("rank").cast("int").alias("rank")))
    once = every.groupBy(*FLOOR, point_id, "camera_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(*FLOOR, point_id).orderBy("rank"))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("rank")
