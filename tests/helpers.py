"""Small hand scenes."""

from pyspark.sql import functions as F

from floorlens.functions import geometry as g

UNIT = f"building_id bigint, ordinal int, unit_id string, pos int, name string, category string, security string, polygon {g.RING}"
CAMERA = (
    f"building_id bigint, ordinal int, camera_id string, pos int, at {g.POINT}, heading double, fov_deg double, range_m double, "
    "kind string, name string, tilt_deg double, mount_m double, vfov_deg double"
)
OPENING = f"building_id bigint, opening_id string, pos int, unit_id string, at {g.POINT}, kind string, style string, width_m double, height_m double"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def pts(v):
    return [(float(x), float(y)) for x, y in v]


def units(spark, rows):
    """rows: (unit_id, category, ring[, name[, security[, ordinal]]])"""
    out = []
    for i, r in enumerate(rows):
        uid, cat, ring, *rest = r
        name, sec, o = (list(rest) + [None] * 3)[:3]
        out.append((1, o or 0, uid, i, uid if name is None else name, cat, sec, pts(ring)))
    return spark.createDataFrame(out, UNIT)


def cameras(spark, rows):
    out = []
    for i, c in enumerate(rows):
        out.append((
            1, c.get("ordinal", 0), c.get("id", f"c{i}"), i, tuple(map(float, c["at"])), float(c.get("heading", 0)), float(c.get("fov", 60)),
            float(c.get("range", 20)), c.get("kind", "fixed"), c.get("name", f"c{i}"), c.get("tilt"), c.get("mount"), c.get("vfov"),
        ))
    return spark.createDataFrame(out, CAMERA)


def openings(spark, rows):
    out = [(1, oid, i, unit, tuple(map(float, at)), kind, None, None, None) for i, (oid, unit, at, kind) in enumerate(rows)]
    return spark.createDataFrame(out, OPENING)


def footprints(spark, rings):
    return spark.createDataFrame(
        [(1, 0, i, pts(r)) for i, r in enumerate(rings)], f"building_id bigint, ordinal int, pos int, polygon {g.RING}"
    )


def structures(spark, rows):
    return spark.createDataFrame(
        [(1, 0, f"s{i}", i, "column", pts(r), None, base) for i, (r, base) in enumerate(rows)],
        f"building_id bigint, ordinal int, structure_id string, pos int, kind string, polygon {g.RING}, height_m double, base_m double",
    )


def verticals(spark, rows):
    return spark.createDataFrame(
        [(1, i, a, b, n) for i, (a, b, n) in enumerate(rows)], "building_id bigint, pos int, unit_a string, unit_b string, name string"
    )


def area(df):
    return {r["camera_id"]: r["a"] for r in df.select("camera_id", g.polygon_area(F.col("ring")).alias("a")).collect()}


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]
