"""CAD entities to layered linework and closed shapes, in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from ..operators.places import auto_doors
from ..operators.spatial import number_rows, once

SEGMENTS = 32
# Drawing unit code and unit name to metres.
UNIT_CODE_M = {1: 0.0254, 2: 0.3048, 4: 0.001, 5: 0.01, 6: 1.0}
UNIT_NAME_M = {"mm": 0.001, "cm": 0.01, "m": 1.0, "in": 0.0254, "ft": 0.3048}


def unit_factor(code: Column, override: str | None = None) -> Column:
    """Metres per drawing unit; an unknown code reads as metres."""
    if override is not None:
        return F.lit(UNIT_NAME_M[override])
    out = F.lit(1.0)
    for c, m in UNIT_CODE_M.items():
        out = F.when(code == c, F.lit(m)).otherwise(out)
    return out


def units_guessed(code: Column) -> Column:
    return ~F.coalesce(code, F.lit(0)).isin(list(UNIT_CODE_M))


def _circle(c: Column, r: Column, start: Column, sweep: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: g.pt(
            c["x"] + r * F.cos(start + sweep * i / SEGMENTS), c["y"] + r * F.sin(start + sweep * i / SEGMENTS)
        ),
    )


def expand_inserts(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Replace block references by the block's entities, one level deep; a
    reference inside a block or to no block stays and is counted as skipped.
    blocks(file_id, block, base, entity columns as b_*)."""
    ins = F.col("type") == "INSERT"
    plain = entities.where(~ins).withColumn("move", F.lit(None).cast(MOVE))
    known = blocks.select("file_id", "block").distinct()
    lost = entities.where(ins).join(known, ["file_id", "block"], "left_anti").withColumn(
        "move", F.lit(None).cast(MOVE)
    )
    inner = blocks.select(
        "file_id", "block", F.col("base").alias("_base"),
        *[F.col(f"b_{c}").alias(c) for c in ("type", "layer", "vertices", "closed", "center", "radius", "start_angle", "end_angle")],
    )
    refs = entities.where(ins).select(
        "file_id", "block", "entity_id", F.coalesce("position", g.pt(0, 0)).alias("_pos"),
        F.coalesce("x_scale", F.lit(1.0)).alias("_sx"), F.coalesce("y_scale", F.lit(1.0)).alias("_sy"),
        F.radians(F.coalesce("rotation", F.lit(0.0))).alias("_rot"),
    )
    placed = refs.join(inner, ["file_id", "block"]).withColumn(
        "move",
        F.struct(
            F.col("_base.x").alias("bx"), F.col("_base.y").alias("by"), F.col("_sx").alias("sx"), F.col("_sy").alias("sy"),
            F.cos("_rot").alias("c"), F.sin("_rot").alias("s"), F.col("_pos.x").alias("tx"), F.col("_pos.y").alias("ty"),
        ),
    ).drop("_base", "_pos", "_sx", "_sy", "_rot")
    return plain.unionByName(lost).unionByName(placed, allowMissingColumns=True)


MOVE = "struct<bx:double,by:double,sx:double,sy:double,c:double,s:double,tx:double,ty:double>"


def _moved(p: Column, m: Column) -> Column:
    lx, ly = (p["x"] - m["bx"]) * m["sx"], (p["y"] - m["by"]) * m["sy"]
    return F.when(m.isNull(), p).otherwise(
        g.pt(lx * m["c"] - ly * m["s"] + m["tx"], lx * m["s"] + ly * m["c"] + m["ty"])
    )


def normalise(entities: DataFrame, blocks: DataFrame, factor: Column | None = None) -> dict[str, DataFrame]:
    """lines (layer polylines), shapes (closed rings of 1 m2 and more), layer
    summary, file extents and skip counts, translated so that each file's
    lowest corner is (1, 1)."""
    # A stored table is but a few splits, and curves are dear to draw.
    spark = entities.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    e = expand_inserts(entities, blocks).repartition(tasks, "file_id")
    kind, two_pi = F.col("type"), 2 * math.pi
    sweep = F.pmod(F.col("end_angle") - F.col("start_angle"), F.lit(two_pi))
    sweep = F.when(sweep == 0, F.lit(two_pi)).otherwise(sweep)
    round_ok = F.col("center").isNotNull() & (F.col("radius") > 0)
    no_repeat = F.filter(
        "vertices", lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(F.col("vertices"), i - 1))
    )
    raw = (
        F.when(kind == "LINE", F.col("vertices"))
        .when(kind.isin("LWPOLYLINE", "POLYLINE"), no_repeat)
        .when((kind == "CIRCLE") & round_ok, _circle(F.col("center"), F.col("radius"), F.lit(0.0), F.lit(two_pi), SEGMENTS - 1))
        .when((kind == "ARC") & round_ok & sweep.isNotNull(), _circle(F.col("center"), F.col("radius"), F.col("start_angle"), sweep, SEGMENTS))
    )
    poly = kind.isin("LWPOLYLINE", "POLYLINE")
    k = F.size("pts")
    back = (k >= 2) & (F.get("pts", F.lit(0)) == F.get("pts", k - 1))
    d = (
        once(once(e, raw=raw), pts=F.transform("raw", lambda p: _moved(p, F.col("move"))))
        .drop("raw")
        .withColumn("is_ring", (kind == "CIRCLE") | (poly & (F.coalesce("closed", F.lit(False)) | back)))
        .withColumn("pts", F.when(poly & back, F.slice("pts", 1, k - 1)).otherwise(F.col("pts")))
        .withColumn(
            "finite",
            F.forall("pts", lambda p: (p["x"] == p["x"]) & (F.abs(p["x"]) < float("inf")) & ~F.isnan(p["x"])
                     & (F.abs(p["y"]) < float("inf")) & ~F.isnan(p["y"])),
        )
        .withColumn("ok", F.coalesce("finite", F.lit(False)))
    )
    skips = d.where("not ok").groupBy("file_id", F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("skipped"))
    f = factor if factor is not None else F.lit(1.0)
    good = once(
        d.where("ok").select("file_id", "entity_id", F.coalesce("layer", F.lit("0")).alias("layer"), "is_ring", F.col("pts").alias("drawn")),
        pts=F.transform("drawn", lambda p: g.pt(p["x"] * f, p["y"] * f)),
    ).drop("drawn")
    drawn = good.where(F.size("pts") >= 2)
    b = F.col("box")
    ext = once(drawn, box=g.bbox(F.col("pts"))).groupBy("file_id").agg(
        F.min(b["x0"]).alias("min_x"), F.min(b["y0"]).alias("min_y"),
        F.max(b["x1"]).alias("max_x"), F.max(b["y1"]).alias("max_y"),
    )
    shift = F.transform(
        "pts", lambda p: g.pt(p["x"] + (F.lit(1.0) - F.col("min_x")), p["y"] + (F.lit(1.0) - F.col("min_y")))
    )
    at = once(drawn.join(ext, "file_id"), at=shift).withColumn("pts", F.col("at")).drop("at")
    lines = at.select(
        "file_id", "layer", "entity_id", F.when(F.col("is_ring"), g.closed(F.col("pts"))).otherwise(F.col("pts")).alias("points")
    )
    shapes = at.where(F.col("is_ring") & (F.size("pts") >= 3)).where(g.polygon_area(F.col("pts")) >= 1).select(
        "file_id", "layer", "entity_id", F.col("pts").alias("polygon")
    )
    layers = (
        good.groupBy("file_id", "layer")
        .agg(F.count("*").alias("entities"), F.count_if(F.size("pts") >= 2).alias("polylines"))
        .where("polylines > 0")
    )
    size = ext.select("file_id", (F.col("max_x") - F.col("min_x")).alias("width_m"), (F.col("max_y") - F.col("min_y")).alias("height_m"))
    return {"lines": lines, "shapes": shapes, "layers": layers, "size": size, "skips": skips}


def shapes_to_units(shapes: DataFrame, placement: DataFrame, units, openings, category: str) -> dict[str, DataFrame]:
    """Closed shapes become units "<layer> n" on the floor each file is placed
    on (file_id, building_id, ordinal); a new corridor gives the floor's
    doorless rooms their doors."""
    n = number_rows(shapes, ["file_id", "layer"], "entity_id", "n")
    new = n.join(placement, "file_id").select(
        "building_id", "ordinal", F.concat_ws("-", F.lit("cad"), "file_id", "layer", "n").alias("unit_id"),
        (F.lit(1_000_000) + F.col("n")).cast("int").alias("pos"), F.concat_ws(" ", "layer", F.col("n").cast("string")).alias("name"),
        F.lit(category).alias("category"), F.lit(None).cast("string").alias("security"), "polygon",
    )
    all_units = units.unionByName(new)
    doors = openings
    if category == "corridor":
        made = auto_doors(all_units, openings).select(
            "building_id", F.concat(F.lit("d-"), "unit_id").alias("opening_id"), "unit_id", "at"
        )
        doors = openings.unionByName(made, allowMissingColumns=True)
    return {"units": all_units, "openings": doors}


def replace_underlays(underlays: DataFrame, lines: DataFrame, placement: DataFrame) -> DataFrame:
    """The imported linework takes the place of each target floor's underlay."""
    keys = ["building_id", "ordinal"]
    new = lines.join(placement, "file_id").select(*keys, F.lit("CAD import").alias("name"), "points", F.lit(0.5).alias("opacity"))
    return underlays.join(placement, keys, "left_anti").unionByName(new)
