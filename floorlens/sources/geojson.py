"""GeoJSON floor plans: feature rows out and in, one collection per type.

A document is written as lines in order (header, one feature per line,
footer), so that a very large building is spread over tasks and part files
that concatenate to the document. `namespace` names the foreign member and the
prefix of non-standard features; pass another tool's to exchange with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import documents
from ..functions import geometry as g, labels
from ..operators.places import occupant_anchors
from ..operators.spatial import FLOOR

NAMESPACE = "floorlens"
_ORIGIN = ("origin_lng", "origin_lat")


def _o():
    return F.col(_ORIGIN[0]), F.col(_ORIGIN[1])


def _geom(kind: str, coords) -> F.Column:
    return F.struct(F.lit(kind).alias("type"), coords.alias("coordinates"))


def _feature(fid, props, geometry, options=None):
    parts = [F.lit("Feature").alias("type")]
    if fid is not None:
        parts.append(fid.alias("id"))
    return F.to_json(F.struct(*parts, props.alias("properties"), geometry.alias("geometry")), options or {})


def _rows(df, section: int, js) -> DataFrame:
    return df.select("building_id", F.lit(section).alias("section"), F.col("pos").cast("long").alias("pos"), js.alias("feature"))


def _props(**kw):
    return F.struct(*[(v if not isinstance(v, str) else F.col(v)).alias(k.replace("__", ":")) for k, v in kw.items()])


def camera_properties(ns: str):
    return F.struct(
        F.lit("camera").alias(f"{ns}:type"), "ordinal", "heading", F.col("fov_deg").alias("fovDeg"),
        F.col("range_m").alias("rangeM"), "kind", "name",
    )


def features(buildings, units, openings, verticals, cameras, occupants, namespace: str = NAMESPACE) -> DataFrame:
    """(building_id, section, pos, feature): every feature of the single-file
    export. The format carries no access level, opening kind, tilt or service
    data; use building files for full fidelity."""
    org = buildings.select("building_id", *_ORIGIN)
    lng, lat = _o()
    b = lambda d: d.join(org, "building_id")
    at = _geom("Point", g.m2ll(lng, lat, F.col("at")))
    poly = _geom("Polygon", F.array(g.polygon_ring(lng, lat, F.col("polygon"))))
    centre = lambda s: units.select(
        "building_id", F.col("unit_id").alias(f"unit_{s}"), g.polygon_centroid(F.col("polygon")).alias(f"c_{s}")
    )
    rise = verticals.join(centre("a"), ["building_id", "unit_a"], "left").join(
        centre("b"), ["building_id", "unit_b"], "left"
    )
    line = F.when(
        F.col("c_a").isNotNull() & F.col("c_b").isNotNull(),
        _geom("LineString", F.array(g.m2ll(lng, lat, F.col("c_a")), g.m2ll(lng, lat, F.col("c_b")))),
    )
    keep_null = {"ignoreNullFields": "false"}
    parts = [
        _rows(b(units), 0, _feature(F.col("unit_id"), _props(feature_type=F.lit("unit"), name="name", category="category", ordinal="ordinal"), poly)),
        _rows(b(openings), 1, _feature(F.col("opening_id"), _props(feature_type=F.lit("opening"), unit="unit_id"), at)),
        _rows(b(rise), 2, _feature(None, _props(feature_type=F.lit("relationship"), category=F.lit("vertical_connection"), a="unit_a", b="unit_b", name="name"), line, keep_null)),
        _rows(b(cameras), 3, _feature(F.col("camera_id"), camera_properties(namespace), at)),
        _rows(
            b(occupant_anchors(occupants, units)), 4,
            _feature(
                F.col("occupant_id"),
                F.struct(F.lit("occupant").alias(f"{namespace}:type"), F.col("unit_id").alias("unit"), "name", "category", "hours", "phone", "website"),
                at,
            ),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def document_lines(feats: DataFrame, buildings, levels, verticals, namespace: str = NAMESPACE) -> DataFrame:
    """(building_id, section, pos, line): the whole document in order."""
    def packed(df, name, order, *cols):
        return df.groupBy("building_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*cols).alias("e")))), lambda s: s["e"]).alias(name)
        )

    head = (
        buildings.join(packed(levels, "levels", "ordinal", "ordinal", "name"), "building_id", "left")
        .join(packed(verticals, "verticals", "pos", F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), "name"), "building_id", "left")
    )
    meta = F.to_json(F.struct(F.lit(1).alias("version"), F.array(*_ORIGIN).alias("origin"), "levels", "verticals"))
    head = head.select(
        "building_id", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit('{"type":"FeatureCollection","' + namespace + '":'), meta, F.lit(',"features":[')).alias("line"),
    )
    foot = buildings.select(
        "building_id", F.lit(99).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit("]}").alias("line")
    )
    first = feats.groupBy("building_id").agg(F.min(F.struct("section", "pos")).alias("first"))
    body = feats.join(first, "building_id").select(
        "building_id", "section", "pos",
        F.concat(F.when(F.struct("section", "pos") == F.col("first"), "").otherwise(","), "feature").alias("line"),
    )
    return head.unionByName(body).unionByName(foot)


def write_documents(lines: DataFrame, path: str) -> None:
    """One valid file per building."""
    documents.write(lines, path, ["section", "pos"])


_FEATURE = (
    "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
)


def read_documents(files: DataFrame, namespace: str = NAMESPACE) -> dict[str, DataFrame]:
    """files(file_id, text) -> units, openings, cameras, occupants, rejects."""
    org = F.from_json(F.get_json_object("text", f"$.{namespace}.origin"), "array<double>")
    feats = F.from_json(F.get_json_object("text", "$.features"), f"array<{_FEATURE}>")
    d = files.withColumns({"org": org, "feats": feats})
    good = d.where("size(org) = 2")
    f = good.select("file_id", "org", F.posexplode("feats").alias("pos", "f"))
    prop = lambda k: F.try_element_at("f.properties", F.lit(k))
    lng0, lat0 = F.get("org", F.lit(0)), F.get("org", F.lit(1))
    kind = prop(f"{namespace}:type")
    shape = F.col("f.geometry.type")
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    point = g.ll2m(lng0, lat0, F.get(xy, F.lit(0)), F.get(xy, F.lit(1)))
    ext = F.coalesce(kind, F.lit(""))
    outer = F.get(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), F.lit(0))
    open_ring = g.let(
        F.coalesce(outer, F.array().cast("array<array<double>>")),
        lambda r: F.when(
            (F.size(r) >= 2) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)
        ).otherwise(r),
    )
    num = lambda k, dflt: F.coalesce(prop(k).try_cast("double"), F.lit(float(dflt)))
    is_unit = (ext == "") & (prop("feature_type") == "unit") & (shape == "Polygon")
    units = f.where(is_unit).select(
        "file_id", F.coalesce("f.id", F.concat(F.lit("u-"), "pos")).alias("unit_id"), "pos",
        num("ordinal", 0).cast("int").alias("ordinal"), F.coalesce(prop("name"), F.lit("Unit")).alias("name"),
        labels.to_category(prop("category")).alias("category"),
        F.transform(open_ring, lambda p: g.ll2m(lng0, lat0, F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("polygon"),
    )
    openings = f.where((ext == "") & (prop("feature_type") == "opening") & (shape == "Point")).select(
        "file_id", F.coalesce("f.id", F.concat(F.lit("d-"), "pos")).alias("opening_id"), "pos",
        F.coalesce(prop("unit"), F.lit("")).alias("unit_id"), point.alias("at"),
    )
    cameras = f.where((ext == "camera") & (shape == "Point")).select(
        "file_id", F.coalesce("f.id", F.concat(F.lit("cam-"), "pos")).alias("camera_id"), "pos",
        num("ordinal", 0).cast("int").alias("ordinal"), point.alias("at"), num("heading", 0).alias("heading"),
        num("fovDeg", 90).alias("fov_deg"), num("rangeM", 8).alias("range_m"),
        F.coalesce(prop("kind"), F.lit("fixed")).alias("kind"), F.coalesce(prop("name"), F.lit("Camera")).alias("name"),
    )
    occupants = f.where(ext == "occupant").select(
        "file_id", F.coalesce("f.id", F.concat(F.lit("occ-"), "pos")).alias("occupant_id"), "pos",
        F.coalesce(prop("name"), F.lit("Occupant")).alias("name"), F.coalesce(prop("unit"), F.lit("")).alias("unit_id"),
        F.coalesce(prop("category"), F.lit("other")).alias("category"), prop("hours").alias("hours"),
        prop("phone").alias("phone"), prop("website").alias("website"),
        F.when(xy.isNotNull(), point).alias("anchor"),
    ).join(units.select("file_id", "unit_id"), ["file_id", "unit_id"], "left_semi")
    loaded = units.select("file_id").distinct()
    return {
        "units": units,
        "openings": openings.join(loaded, "file_id", "left_semi"),
        "cameras": cameras.join(loaded, "file_id", "left_semi"),
        "occupants": occupants,
        "rejects": files.select("file_id").join(loaded, "file_id", "left_anti"),
    }


def extents(units: DataFrame, levels: DataFrame) -> dict[str, DataFrame]:
    """Bounding boxes of buildings and levels; an empty level takes the
    building's box."""
    corner = g.bbox(F.col("polygon"))
    box = lambda d: d.agg(
        F.min(corner["x0"]).alias("x0"), F.min(corner["y0"]).alias("y0"),
        F.max(corner["x1"]).alias("x1"), F.max(corner["y1"]).alias("y1"),
    )
    venue = box(units.groupBy("building_id"))
    floor = box(units.groupBy(*FLOOR)).select(*FLOOR, F.struct("x0", "y0", "x1", "y1").alias("own"))
    level = levels.join(floor, FLOOR, "left").join(venue, "building_id", "left").select(
        *FLOOR, "name", F.coalesce("own", F.struct("x0", "y0", "x1", "y1")).alias("b")
    ).select(*FLOOR, "name", "b.*")
    return {"venue": venue, "level": level}


def archive(buildings, levels, units, openings, occupants, cameras, structures, verticals, namespace: str = NAMESPACE) -> dict[str, DataFrame]:
    """One feature table per type: venue, building, level, unit, opening,
    anchor, occupant, camera, zone, structure and manifest."""
    org = buildings.select("building_id", *_ORIGIN)
    lng, lat = _o()
    at = _geom("Point", g.m2ll(lng, lat, F.col("at")))
    poly = _geom("Polygon", F.array(g.polygon_ring(lng, lat, F.col("polygon"))))
    keep = {"ignoreNullFields": "false"}
    ext = extents(units, levels)
    rect = F.when(F.col("x0").isNotNull(), _geom("Polygon", F.array(g.polygon_ring(lng, lat, g.rect_poly(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))))
    whole = buildings.select("building_id", *_ORIGIN).join(ext["venue"], "building_id", "left")
    row = lambda d, js: d.select("building_id", js.alias("feature"))
    b = lambda d: d.join(org, "building_id")
    anchors = b(occupant_anchors(occupants, units))
    sec = labels.security_of(F.col("security"))
    zones = (
        b(units).withColumn("zone", sec).groupBy("building_id", "zone")
        .agg(F.count("*").alias("count"), F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.array(g.polygon_ring(lng, lat, F.col("polygon"))).alias("p")))), lambda s: s["p"]).alias("polygons"))
    )
    anchor_id = F.concat(F.lit("anchor-"), "occupant_id")
    manifest = document_lines(units.limit(0).select("building_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("feature")), buildings, levels, verticals, namespace).where("section = -1")
    return {
        "venue": row(whole, _feature(F.lit("venue"), _props(feature_type=F.lit("venue"), name=F.lit("Venue")), rect, keep)),
        "building": row(whole, _feature(F.lit("building"), _props(feature_type=F.lit("building"), name=F.lit("Building")), rect, keep)),
        "level": row(b(ext["level"]), _feature(F.concat(F.lit("level-"), "ordinal"), _props(feature_type=F.lit("level"), ordinal="ordinal", name="name"), rect, keep)),
        "unit": row(b(units), _feature(F.col("unit_id"), _props(feature_type=F.lit("unit"), name="name", category="category", ordinal="ordinal", security=sec), poly)),
        "opening": row(b(openings), _feature(F.col("opening_id"), _props(feature_type=F.lit("opening"), unit="unit_id", kind=F.coalesce("kind", F.lit("door"))), at)),
        "anchor": row(anchors, _feature(anchor_id, _props(feature_type=F.lit("anchor"), unit_id="unit_id"), at)),
        "occupant": row(anchors, _feature(F.col("occupant_id"), F.struct(F.lit("occupant").alias("feature_type"), "name", "category", "hours", "phone", "website", anchor_id.alias("anchor_id")), F.lit(None).cast("string"))),
        "camera": row(b(cameras), _feature(F.col("camera_id"), camera_properties(namespace), at)),
        "zone": row(zones, _feature(F.concat(F.lit("zone-"), "zone"), _props(feature_type=F.lit("zone"), security="zone", count="count"), _geom("MultiPolygon", F.col("polygons")))),
        "structure": row(b(structures), _feature(F.col("structure_id"), F.struct(F.lit("structure").alias(f"{namespace}:type"), "ordinal", "kind", F.col("height_m").alias("heightM"), F.coalesce("base_m", F.lit(0.0)).alias("baseM")), poly, keep)),
        "manifest": manifest.select("building_id", F.concat(F.regexp_replace("line", r'^\{"type":"FeatureCollection",', "{"), F.lit("]}")).alias("feature")),
    }


def write_archive(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.withColumnRenamed("feature", "value").write.partitionBy("building_id").text(f"{path}/{name}")
