"""Deliverables: security report, camera index export, map feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import documents
from ..functions import geometry as g, labels
from ..operators.places import occupant_names
from ..operators.spatial import FLOOR


def report_lines(levels, units, cameras, coverage, regions, stamp: str) -> DataFrame:
    """(building_id, level, part, pos, line): a Markdown report per building,
    one line per row, in order by the three keys."""
    one = lambda v: F.format_string("%.1f", v)
    whole = lambda v: F.floor(v + 0.5).cast("bigint").cast("string")
    count = lambda d, n: d.groupBy("building_id").agg(F.count("*").alias(n))
    head = (
        count(levels, "n_levels").join(count(units, "n_units"), "building_id", "left")
        .join(count(cameras, "n_cams"), "building_id", "left").fillna(0)
    )
    row = lambda d, level, part, pos, line: d.select(
        "building_id", level.cast("int").alias("level"), F.lit(part).alias("part"), pos.cast("long").alias("pos"), line.alias("line")
    )
    def block(d, level, part, *lines):
        return d.select(
            "building_id", level.cast("int").alias("level"), F.lit(part).alias("part"),
            F.posexplode(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in lines])).alias("pos", "line"),
        ).withColumn("pos", F.col("pos").cast("long"))

    top = block(
        head, F.lit(-1), 0, "# Security Report", "", f"Generated {stamp}", "",
        F.concat(F.lit("**"), "n_levels", F.lit("** floor(s) · **"), "n_units", F.lit("** units · **"), "n_cams", F.lit("** camera(s)")), "",
    )
    lv = F.col("ordinal")
    title = block(levels, lv, 0, F.concat(F.lit("## "), "name", F.lit(" (ordinal "), "ordinal", F.lit(")")), "")
    has = cameras.select(*FLOOR).distinct()
    none = block(levels.join(has, FLOOR, "left_anti"), lv, 1, "_No cameras on this floor._", "")
    table = block(
        has, lv, 1, "### Cameras", "", "| id | kind | heading | fov | range | name |", "|----|------|---------|-----|-------|------|"
    )
    dome = F.col("kind") == "dome"
    cams = row(
        cameras, lv, 2, F.col("pos"),
        F.concat(
            F.lit("| "), "camera_id", F.lit(" | "), "kind", F.lit(" | "),
            F.when(dome, "—").otherwise(F.concat(whole(F.col("heading")), F.lit("°"))), F.lit(" | "),
            F.when(dome, "360°").otherwise(F.concat(whole(F.col("fov_deg")), F.lit("°"))), F.lit(" | "),
            one(F.col("range_m")), F.lit(" m | "), "name", F.lit(" |"),
        ),
    )
    gap = block(has, lv, 3, "")
    n_regions = regions.groupBy(*FLOOR).agg(F.count("*").alias("regions"))
    area = levels.join(coverage, FLOOR, "left").join(n_regions, FLOOR, "left").fillna(0)
    cover = block(
        area, lv, 4, "### Coverage", "",
        F.concat(F.lit("- Floor area: **"), one(F.col("floor_m2")), F.lit(" m²**")),
        F.concat(F.lit("- Covered: **"), one(F.col("covered_m2")), F.lit(" m²** (**"), F.format_string("%.0f", F.col("coverage_pct") * 100), F.lit("%**)")),
        F.concat(F.lit("- Blind spots: **"), "regions", F.lit("** region(s), **"), one(F.col("blind_m2")), F.lit(" m²**")), "",
    )
    out = top
    for p in (title, none, table, cams, gap, cover):
        out = out.unionByName(p)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """One file per building."""
    documents.write(lines, path, ["level", "part", "pos"])


def index_json(index: DataFrame) -> DataFrame:
    """One JSON row per space-camera pair of the ranked index."""
    return index.select("building_id", F.to_json(F.struct(*[c for c in index.columns if c != "building_id"])).alias("value"))


def map_units(buildings, units, levels, occupants) -> DataFrame:
    lv = levels.select(*FLOOR, labels.level_ceiling(F.col("ceiling_m")).alias("ceiling"))
    ring = g.polygon_ring(F.col("origin_lng"), F.col("origin_lat"), F.col("polygon"))
    return (
        units.join(buildings.select("building_id", "origin_lng", "origin_lat"), "building_id")
        .join(lv, FLOOR, "left").fillna(labels.DEFAULT_CEILING_M, ["ceiling"])
        .join(occupant_names(occupants), ["building_id", "unit_id"], "left")
        .select(
            *FLOOR, "unit_id", "category", labels.function_bucket(F.col("unit_id"), F.col("category")).alias("func"), "name",
            F.coalesce("names", F.lit("")).alias("occupant"), labels.security_of(F.col("security")).alias("security"),
            labels.unit_height(F.col("category"), F.col("ceiling")).alias("height_m"), ring.alias("ring"),
        )
    )


def map_shapes(buildings, shapes, ring: str = "polygon", closed: bool = True) -> DataFrame:
    """Any outline or line table with its coordinates as lng/lat."""
    lng, lat = F.col("origin_lng"), F.col("origin_lat")
    conv = g.polygon_ring(lng, lat, F.col(ring)) if closed else g.points_to_ll(lng, lat, F.col(ring))
    return shapes.join(buildings.select("building_id", "origin_lng", "origin_lat"), "building_id").withColumn(
        "coordinates", conv
    ).drop("origin_lng", "origin_lat", ring)
