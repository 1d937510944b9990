"""Floor geometry in height: walls with holes, prisms, voids, camera poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as g, labels, optics
from ..operators.places import nearest_edge, occupant_names
from ..operators.spatial import FLOOR
from ..operators.walls import first_footprints, has_area

SLAB_M = 0.45
JAMB_M = 0.35
# The finish that wins on a shared wall, highest first.
FINISH_RANK = {
    "envelope": 100, "retail": 60, "lobby": 55, "room": 50, "office": 45, "restroom": 40,
    "mechanical": 35, "storage": 30, "stairs": 25, "elevator": 25, "corridor": 10, "outside": 0,
}
EDGE = [*FLOOR, "edge"]


def _mm(x):
    return F.floor(x * 1000 + 0.5).cast("bigint").cast("string")


def edge_key(ax, ay, bx, by):
    """Same text for both directions of an edge, at 1 mm."""
    a, b = F.concat_ws(",", _mm(ax), _mm(ay)), F.concat_ws(",", _mm(bx), _mm(by))
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def ceilings(levels: DataFrame) -> DataFrame:
    return levels.select(
        *FLOOR, labels.level_ceiling(F.col("ceiling_m")).alias("ceiling"),
        (labels.level_ceiling(F.col("ceiling_m")) + SLAB_M).alias("storey_m"),
    )


def merged_walls(units: DataFrame, footprints: DataFrame, levels: DataFrame) -> DataFrame:
    """Edges of full-height units and of the outline, coincident ones merged:
    tallest top, most specific finish, direction of the first."""
    src = (
        units.where(labels.is_full_height(F.col("category")) & has_area())
        .select(*FLOOR, "pos", F.col("category").alias("finish"), "polygon")
        .unionByName(
            first_footprints(footprints).select(*FLOOR, F.lit(2**31 - 1).alias("pos"), F.lit("envelope").alias("finish"), "polygon")
        )
    )
    e = src.select(*FLOOR, "pos", "finish", F.inline(g.ring_edges(F.col("polygon")))).join(ceilings(levels), FLOOR)
    rank = labels.lookup(FINISH_RANK, F.col("finish"), 0)
    return (
        e.withColumn("edge", edge_key(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
        .groupBy(*EDGE)
        .agg(
            F.min_by(F.struct("ax", "ay", "bx", "by"), F.struct("pos", "i")).alias("w"),
            F.max("ceiling").alias("top_m"),
            F.max_by("finish", F.struct(rank, -F.col("pos"))).alias("finish"),
            F.count("*").alias("sides"),
        )
        .select(*EDGE, "w.*", "top_m", "finish", "sides")
    )


def wall_holes(openings, units, occupants, levels, walls3d) -> DataFrame:
    """Openings cut into the wall they belong to, clear of the jambs; on one
    wall the earlier opening wins where two overlap."""
    e = F.col("edge0")
    host = nearest_edge(openings, units.where(has_area())).withColumnRenamed("edge", "edge0").where(
        labels.is_full_height(F.col("category"))
    )
    d = (
        host.withColumn("edge", edge_key(e["ax"], e["ay"], e["bx"], e["by"]))
        .join(walls3d.select(*EDGE, "ax", "ay", "bx", "by", "top_m"), EDGE)
        .join(ceilings(levels).select(*FLOOR, "ceiling"), FLOOR)
        .join(occupant_names(occupants), ["building_id", "unit_id"], "left")
        .withColumn("len", g.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
        .where(F.col("len") >= 2 * JAMB_M + 0.3)
        .withColumn("style", labels.opening_style(F.col("style"), F.col("kind"), F.col("category")))
    )
    width = F.least(
        F.coalesce("width_m", labels.opening_default_width(F.col("style"), F.col("len"))),
        F.greatest(F.lit(0.3), F.col("len") - 2 * JAMB_M),
    )
    head = F.least(
        F.coalesce("height_m", labels.opening_default_height(F.col("style"))), F.least("top_m", "ceiling") - 0.12
    )
    t = g.seg_t(F.col("at.x"), F.col("at.y"), e["ax"], e["ay"], e["bx"], e["by"])
    same = (_mm(F.col("ax")) == _mm(e["ax"])) & (_mm(F.col("ay")) == _mm(e["ay"]))
    d = d.withColumns({"width": width, "head_m": head, "t": F.when(same, t).otherwise(1 - t)}).where("head_m > 0.5")
    half = F.col("width") / 2
    c = g.polygon_centroid(F.col("polygon"))
    d = d.withColumn("centre", c).withColumns(
        {
            "at_m": F.least(F.greatest(F.col("t") * F.col("len"), JAMB_M + half), F.col("len") - JAMB_M - half),
            "outward": F.when(
                -(F.col("by") - F.col("ay")) * (F.col("centre.x") - (F.col("ax") + F.col("bx")) / 2)
                + (F.col("bx") - F.col("ax")) * (F.col("centre.y") - (F.col("ay") + F.col("by")) / 2) > 0, -1,
            ).otherwise(1),
        }
    )
    hole = F.struct(
        "pos", "opening_id", "style", "at_m", "width", "head_m", "outward",
        F.when(F.col("style") == "storefront", F.coalesce("names", "unit_name")).alias("label"),
    )
    # Holes per wall are bounded by its length over the smallest hole once kept;
    # the fold carries kept holes only.
    kept = F.aggregate(
        F.col("cand"), F.slice("cand", 1, 0),
        lambda acc, h: F.when(
            F.exists(acc, lambda k: F.abs(k["at_m"] - h["at_m"]) < (k["width"] + h["width"]) / 2), acc
        ).otherwise(F.array_append(acc, h)),
    )
    return (
        d.groupBy(*EDGE).agg(F.array_sort(F.collect_list(hole)).alias("cand"))
        .select(*EDGE, F.inline(kept))
        .drop("pos")
    )


def prisms(units, structures, fixtures, levels) -> DataFrame:
    """Slabs, structures and fixtures as vertical extrusions."""
    low = labels.lookup(labels.LOW_SLAB_M, F.col("category"))
    row = lambda d, kind, key, what, base, top: d.select(
        *FLOOR, F.lit(kind).alias("prism"), F.col(key).alias("id"), F.col(what).alias("kind"),
        base.cast("double").alias("base_m"), top.cast("double").alias("top_m"), "polygon",
    )
    slabs = row(units.where(has_area() & (low > 0)), "slab", "unit_id", "category", F.lit(0.0), low)
    s = structures.where(has_area()).join(ceilings(levels), FLOOR).withColumn(
        "x", labels.structure_extent(F.col("height_m"), F.col("base_m"), F.col("ceiling"))
    )
    solid = row(s, "structure", "structure_id", "kind", F.col("x.base_m"), F.col("x.top_m"))
    h = labels.fixture_height(F.col("kind"))
    furniture = row(fixtures.where(has_area() & (h > 0)), "fixture", "fixture_id", "kind", F.lit(0.0), h)
    return slabs.unionByName(solid).unionByName(furniture)


def voids(v: DataFrame) -> DataFrame:
    """Holes in each plate, and the same holes as openings in the ceiling of
    the floor below."""
    ok = v.where(has_area())
    return ok.select(*FLOOR, "void_id", F.lit("plate").alias("surface"), "polygon").unionByName(
        ok.select("building_id", (F.col("ordinal") - 1).alias("ordinal"), "void_id", F.lit("ceiling").alias("surface"), "polygon")
    )


def camera_poses(cameras, levels) -> DataFrame:
    top = F.col("ceiling") - 0.1
    mount = F.coalesce("mount_m", optics.default_mount_m(F.col("ceiling")))
    return cameras.join(ceilings(levels), FLOOR).select(
        *FLOOR, "camera_id", "at",
        F.greatest(F.lit(0.1), F.least(mount, top)).alias("mount_m"), "heading",
        F.coalesce("tilt_deg", F.lit(0.0)).alias("tilt_deg"), F.coalesce("roll_deg", F.lit(0.0)).alias("roll_deg"), "fov_deg",
        F.when(F.col("vfov_deg").isNotNull(), g.clamp(F.col("vfov_deg"), 1, 179)).otherwise(optics.derive_vfov_deg(F.col("fov_deg"))).alias("vfov_deg"),
        "range_m", "kind", F.coalesce("mount", F.lit("ceiling")).alias("mount"), "storey_m",
    )


def floor_patches(units: DataFrame) -> DataFrame:
    return units.where(F.size("polygon") >= 3).select(*FLOOR, "unit_id", "category", "polygon")


