"""Building save files: read with a shape gate and rejects, write, choose.

A file holds one building as JSON, bare or inside an envelope
``{format, version, propertyId, building}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import documents
from ..functions import geometry as g
from ..operators.spatial import once
from ..session import cut, stored

FORMAT = "floorlens-building"
_XY = "array<double>"
_RING = "array<array<double>>"
BUILDING = (
    f"struct<origin:{_XY},demoRev:int,"
    "levels:array<struct<ordinal:int,name:string,ceilingM:double>>,"
    f"units:array<struct<id:string,ordinal:int,name:string,category:string,security:string,polygon:{_RING}>>,"
    f"openings:array<struct<id:string,unit:string,at:{_XY},kind:string,style:string,widthM:double,heightM:double>>,"
    "verticals:array<struct<a:string,b:string,name:string>>,"
    f"cameras:array<struct<id:string,ordinal:int,at:{_XY},heading:double,fovDeg:double,rangeM:double,kind:string,"
    "name:string,streamRef:string,tiltDeg:double,mountM:double,rollDeg:double,mount:string,opNumber:int,vfovDeg:double,"
    "status:string,model:string,serial:string,ipAddress:string,resolutionMP:double,installedOn:string,"
    "lastServicedOn:string,notes:string,"
    "presets:array<struct<slot:int,name:string,heading:double,tiltDeg:double,fovDeg:double,rangeM:double>>>>,"
    f"incidents:array<struct<id:string,ordinal:int,at:{_XY},kind:string,note:string>>,"
    f"patrols:array<struct<id:string,ordinal:int,name:string,points:{_RING}>>,"
    f"amenities:array<struct<id:string,ordinal:int,at:{_XY},kind:string,name:string>>,"
    f"fixtures:array<struct<id:string,ordinal:int,kind:string,polygon:{_RING}>>,"
    f"footprints:array<struct<ordinal:int,polygon:{_RING}>>,"
    f"structures:array<struct<id:string,ordinal:int,kind:string,polygon:{_RING},heightM:double,baseM:double>>,"
    f"voids:array<struct<id:string,ordinal:int,polygon:{_RING}>>,"
    f"occupants:array<struct<id:string,name:string,unitId:string,category:string,hours:string,phone:string,website:string,anchor:{_XY}>>,"
    f"vectorUnderlays:array<struct<ordinal:int,name:string,polylines:array<{_RING}>,opacity:double>>,"
    "underlays:array<struct<ordinal:int,dataUrl:string,naturalW:double,naturalH:double,widthM:double,offset:array<double>,rotation:double,opacity:double>>,"
    "siteInfo:struct<hours:string,photos:array<string>>,"
    "cameraViews:array<struct<id:string,name:string,cameraIds:array<string>>>>"
)
DEFAULTED = [
    "cameras", "incidents", "patrols", "amenities", "fixtures", "footprints",
    "underlays", "occupants", "vectorUnderlays", "structures", "voids",
]


def parse_files(files: DataFrame, accepted: str = FORMAT) -> DataFrame:
    """files(file_id, text) -> parsed building, property id and `ok`. A file
    with an unknown `format`, or whose building fails the shape gate, is kept
    with ok = false."""
    d = once(files, _format=F.get_json_object("text", "$.format"))
    enveloped = F.col("_format").isNotNull()
    envelope = F.from_json("text", f"struct<propertyId:string,building:{BUILDING}>")
    bare = F.struct(F.lit(None).cast("string").alias("propertyId"), F.from_json("text", BUILDING).alias("building"))
    d = once(d, _doc=F.when(enveloped, envelope).otherwise(bare))
    d = d.withColumn("building", F.when(~enveloped | (F.col("_format") == accepted), F.col("_doc.building")))
    return (
        d.withColumn("property_id", F.col("_doc.propertyId"))
        .withColumn("ok", F.coalesce(valid_shape(F.col("building")), F.lit(False)))
        .drop("_doc", "_format")
    )


def valid_shape(b: Column) -> Column:
    """Four collections present, a two-number origin, every unit with a
    polygon and every opening with an id."""
    o = b["origin"]
    return (
        b["units"].isNotNull() & b["levels"].isNotNull() & b["openings"].isNotNull()
        & b["verticals"].isNotNull() & (F.size(o) == 2) & F.forall(o, lambda v: v.isNotNull())
        & F.forall(b["units"], lambda u: u["polygon"].isNotNull())
        & F.forall(b["openings"], lambda p: p["id"].isNotNull())
    )


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("not ok").select("file_id", "text")


def collection(parsed: DataFrame, name: str) -> DataFrame:
    """One entity per row with its array position; absent reads as empty."""
    items = F.col(f"building.{name}")
    if name in DEFAULTED:
        items = F.coalesce(items, F.array().cast(parsed.select(items.alias("c")).schema["c"].dataType))
    return (
        parsed.where("ok")
        .select("file_id", F.posexplode(items).alias("pos", "e"))
        .select("file_id", "pos", "e.*")
    )


def ring(c: str) -> Column:
    """[[x, y], ...] -> array of points."""
    return F.transform(c, lambda p: g.pt(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


#: Collection of a file to its table: order in the file, and field to column.
TABLES = {
    "levels": ("levels", "ordinal", {"ordinal": "ordinal", "name": "name", "ceilingM": "ceiling_m"}),
    "units": ("units", "pos", {
        "id": "unit_id", "ordinal": "ordinal", "name": "name", "category": "category", "security": "security", "polygon": "polygon"}),
    "openings": ("openings", "pos", {
        "id": "opening_id", "unit": "unit_id", "at": "at", "kind": "kind", "style": "style", "widthM": "width_m", "heightM": "height_m"}),
    "verticals": ("verticals", "pos", {"a": "unit_a", "b": "unit_b", "name": "name"}),
    "cameras": ("cameras", "pos", {
        "id": "camera_id", "ordinal": "ordinal", "at": "at", "heading": "heading", "fovDeg": "fov_deg", "rangeM": "range_m", "kind": "kind", "name": "name",
        "streamRef": "stream_ref", "tiltDeg": "tilt_deg", "mountM": "mount_m", "rollDeg": "roll_deg", "mount": "mount", "opNumber": "op_number",
        "vfovDeg": "vfov_deg", "status": "status", "model": "model", "serial": "serial", "ipAddress": "ip_address", "resolutionMP": "resolution_mp",
        "installedOn": "installed_on", "lastServicedOn": "last_serviced_on", "notes": "notes", "presets": "presets"}),
    "incidents": ("incidents", "incident_id", {"id": "incident_id", "ordinal": "ordinal", "at": "at", "kind": "kind", "note": "note"}),
    "patrols": ("patrols", "patrol_id", {"id": "patrol_id", "ordinal": "ordinal", "name": "name", "points": "points"}),
    "amenities": ("amenities", "pos", {"id": "amenity_id", "ordinal": "ordinal", "at": "at", "kind": "kind", "name": "name"}),
    "fixtures": ("fixtures", "pos", {"id": "fixture_id", "ordinal": "ordinal", "kind": "kind", "polygon": "polygon"}),
    "footprints": ("footprints", "pos", {"ordinal": "ordinal", "polygon": "polygon"}),
    "structures": ("structures", "pos", {
        "id": "structure_id", "ordinal": "ordinal", "kind": "kind", "polygon": "polygon", "heightM": "height_m", "baseM": "base_m"}),
    "voids": ("voids", "void_id", {"id": "void_id", "ordinal": "ordinal", "polygon": "polygon"}),
    "occupants": ("occupants", "pos", {
        "id": "occupant_id", "name": "name", "unitId": "unit_id", "category": "category", "hours": "hours", "phone": "phone",
        "website": "website", "anchor": "anchor"}),
    "vectorUnderlays": ("vector_underlays", "pos", {"ordinal": "ordinal", "name": "name", "polylines": "polylines", "opacity": "opacity"}),
    "underlays": ("underlays", "ordinal", {
        "ordinal": "ordinal", "dataUrl": "data_url", "naturalW": "natural_w", "naturalH": "natural_h", "widthM": "width_m", "offset": "offset",
        "rotation": "rotation", "opacity": "opacity"}),
    "cameraViews": ("camera_views", "pos", {"id": "view_id", "name": "name", "cameraIds": "camera_ids"}),
}
POINTS, RINGS, LINES, DATES = ("at", "anchor", "offset"), ("polygon", "points"), ("polylines",), ("installed_on", "last_serviced_on")


def units_table(parsed: DataFrame) -> DataFrame:
    return table(parsed, "units")


def _point(p: Column) -> Column:
    return F.when(p.isNotNull(), g.pt(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def table(parsed: DataFrame, name: str) -> DataFrame:
    """The table of one collection of parsed files, with `pos` as array order."""
    _, _, fields = TABLES[name]

    def column(field: str, column: str) -> Column:
        c = F.col(field)
        if column in POINTS:
            c = _point(c)
        elif column in RINGS:
            c = F.transform(c, _point)
        elif column in LINES:
            c = F.transform(c, lambda line: F.transform(line, _point))
        elif column in DATES:
            c = c.cast("date")
        return c.alias(column)

    return collection(parsed, name).select(F.col("file_id").alias("building_id"), "pos", *(column(f, c) for f, c in fields.items()))


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """All collections of parsed files as tables, and `camera_presets`."""
    out = {t: table(parsed, name) for name, (t, _, _) in TABLES.items()}
    held = out["cameras"].select("building_id", "camera_id", F.explode("presets").alias("p"))
    out["camera_presets"] = held.select(
        "building_id", "camera_id", "p.slot", "p.name", "p.heading", F.col("p.tiltDeg").alias("tilt_deg"), F.col("p.fovDeg").alias("fov_deg"), F.col("p.rangeM").alias("range_m")
    )
    out["cameras"] = out["cameras"].drop("presets")
    return out


def with_presets(cameras: DataFrame, presets: DataFrame) -> DataFrame:
    """Cameras with their presets (nine at most) in slot order."""
    item = F.struct("slot", "name", "heading", F.col("tilt_deg").alias("tiltDeg"), F.col("fov_deg").alias("fovDeg"), F.col("range_m").alias("rangeM"))
    held = presets.groupBy("building_id", "camera_id").agg(F.array_sort(F.collect_list(item)).alias("presets"))
    return cameras.join(held, ["building_id", "camera_id"], "left")


def _json(df: DataFrame, fields: dict[str, str]) -> Column:
    """One entity; absent fields are left out, points are pairs of numbers."""
    pair = lambda p: F.when(p.isNotNull(), F.array(p["x"], p["y"]))

    def value(column: str) -> Column:
        c = F.col(column)
        if column in POINTS:
            return pair(c)
        if column in RINGS:
            return F.transform(c, pair)
        if column in LINES:
            return F.transform(c, lambda line: F.transform(line, pair))
        return c

    return F.to_json(F.struct(*(value(c).alias(f) for f, c in fields.items() if c in df.columns)))


#: Lines of a file; the line itself tells apart what ties.
ORDER = ["section", "pos", "key", "line"]


def save_lines(buildings: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    """(building_id, section, pos, key, line, text): save files, line by line, the
    lines of a building in one task; `text` is the line with its comma. `given`
    holds tables by name; tables that are missing are empty collections."""
    head = F.concat(
        F.lit(f'{{"format":"{FORMAT}","version":3,"propertyId":"b'), F.col("building_id"), F.lit('","building":{"origin":'),
        F.to_json(F.array("origin_lng", "origin_lat")), F.coalesce(F.concat(F.lit(',"demoRev":'), F.col("rev")), F.lit("")),
    )
    row = lambda df, section, pos, key, line, item=False: df.select(
        "building_id", F.lit(section).alias("section"), pos.cast("long").alias("pos"), key.cast("string").alias("key"), line.alias("line"), F.lit(item).alias("item")
    )
    zero, none = F.lit(0), F.lit("")
    frame = [(0, head)]
    for i, name in enumerate(TABLES):
        frame += [(3 * i + 1, F.lit(f',"{name}":[')), (3 * i + 3, F.lit("]"))]
    frame += [(3 * len(TABLES) + 1, F.lit("}}"))]
    frame = F.inline(F.array(*(F.struct(F.lit(section).alias("section"), line.alias("line")) for section, line in frame)))
    out = buildings.select("building_id", frame).select(
        "building_id", "section", zero.cast("long").alias("pos"), none.alias("key"), "line", F.lit(False).alias("item")
    )
    for i, (source, order, fields) in enumerate(TABLES.values()):
        if source in given:
            df = given[source]
            if source == "cameras" and "camera_presets" in given:
                df = with_presets(df, given["camera_presets"])
            number = dict(df.dtypes)[order] != "string"
            pos, key = (F.col(order), none) if number else (zero, F.col(order))
            out = out.unionByName(df.select(
                "building_id", F.lit(3 * i + 2).alias("section"), pos.cast("long").alias("pos"), key.cast("string").alias("key"),
                _json(df, fields).alias("line"), F.lit(True).alias("item"),
            ))
    order = Window.partitionBy("building_id").orderBy(*ORDER)
    comma = F.when(F.col("item") & (F.lag("section").over(order) == F.col("section")), ",").otherwise("")
    return documents.spread(out).withColumn("text", F.concat(comma, "line")).drop("item")


def read_saves(spark: SparkSession, path: str) -> DataFrame:
    """Parsed files below a path, with the building of their folder as file_id.
    Each file is opened and parsed once and stored, for all of its collections;
    `text` is held for rejects only."""
    files = documents.read(spark, path)
    parsed = parse_files(files.withColumn("file_id", F.regexp_extract("file_id", "building_id=([0-9]+)", 1).cast("long")))
    return stored(parsed.withColumn("text", F.when(~F.col("ok"), F.col("text"))), "parsed")


def write_saves(buildings: DataFrame, given: dict[str, DataFrame], path: str) -> None:
    """One save file per building with every collection and field."""
    documents.write_spread(save_lines(buildings, given), path, ORDER, "text")


def saved_or_pristine(saved: DataFrame, pristine: DataFrame) -> DataFrame:
    """Per property: the save if it is valid and not forked from an older
    shipped revision, else the pristine building. Columns: property_id, ok,
    rev, doc on both sides."""
    s = saved.select("property_id", F.struct("ok", "rev", "doc").alias("s"))
    p = pristine.select("property_id", F.struct("rev", "doc").alias("p"))
    stale = F.col("p.rev").isNotNull() & ~F.col("s.rev").eqNullSafe(F.col("p.rev"))
    use = F.coalesce(F.col("s.ok"), F.lit(False)) & ~F.coalesce(stale, F.lit(False))
    return s.join(p, "property_id", "full").select(
        "property_id", F.when(use, F.col("s.doc")).otherwise(F.col("p.doc")).alias("doc"),
        F.when(use, "saved").otherwise("pristine").alias("origin"),
    )


def migrate_legacy(saves: DataFrame, target: str) -> DataFrame:
    """Copy the un-suffixed legacy save (property_id NULL) to its property
    unless that one already has a save; the legacy row stays."""
    legacy = saves.where("property_id is null")
    taken = saves.where(F.col("property_id") == target).agg(F.count("*").alias("n")).scalar()
    return saves.unionByName(legacy.where(taken == 0).withColumn("property_id", F.lit(target)))


def read_properties(text: DataFrame) -> DataFrame:
    """Registry rows [{id, name}, ...]; malformed entries drop out."""
    rows = F.from_json("text", "array<struct<id:string,name:string>>")
    return text.select(F.explode(rows).alias("p")).select("p.id", "p.name").where(
        "id is not null and name is not null"
    )


def property_names(ids: DataFrame, shipped: DataFrame, user: DataFrame) -> DataFrame:
    """Display name: shipped, else user-made, else the id itself."""
    return (
        ids.join(shipped.select("id", F.col("name").alias("n1")), "id", "left")
        .join(user.select("id", F.col("name").alias("n2")), "id", "left")
        .select("id", F.coalesce("n1", "n2", "id").alias("name"))
    )


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 40)
    return F.when(s == "", F.lit("property")).otherwise(s)


def new_property_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """names(seq, name) -> id: the slug, or slug-2, slug-3 ... past every id in
    use, newcomers of smaller seq included.

    A round gives the k-th newcomer of a slug its k-th free suffix. Slugs that
    differ by a numeric ending can meet in one id; then all newcomers of that
    family before the first loser keep theirs and the others go round again.
    """
    rest = names.withColumn("slug", slug(F.col("name")))
    rest = rest.withColumn("family", F.regexp_replace("slug", "(-[1-9][0-9]*)+$", ""))
    used, kept = taken.select("id"), None
    while True:
        nth = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
        got = cut(_free_ids(rest, used).withColumn("nth", nth))
        stop = got.where("nth > 1").groupBy("family").agg(F.min("seq").alias("stop"))
        marked = got.join(stop, "family", "left").withColumn("sure", F.col("stop").isNull() | (F.col("seq") < F.col("stop")))
        sure = cut(marked.where("sure").select("seq", "name", "id"))
        kept = sure if kept is None else kept.unionByName(sure)
        rest = cut(marked.where("not sure").select("seq", "name", "slug", "family"))
        if rest.isEmpty():
            return kept
        used = used.unionByName(sure.select("id"))


def _free_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """The k-th newcomer of a slug takes its k-th free suffix."""
    from ..operators.spatial import number_rows

    want = number_rows(names, ["slug"], "seq", "k")
    # Suffix numbers already in use per slug: the bare slug counts as 1.
    tail = F.regexp_extract("id", r"^(.*?)-([1-9][0-9]{0,8})$", 2)
    base = F.regexp_extract("id", r"^(.*?)-([1-9][0-9]{0,8})$", 1)
    used = (
        taken.select(F.col("id").alias("slug"), F.lit(1).alias("used"))
        .unionByName(
            taken.where(tail != "").select(base.alias("slug"), tail.cast("int").alias("used")).where("used >= 2")
        )
        .distinct()
    )
    # Free number k = k + how many used numbers lie below it: a used number u,
    # the j-th smallest, pushes every k >= u - j + 1 up by one.
    w = Window.partitionBy("slug").orderBy("used")
    push = used.withColumn("from_k", F.col("used") - F.row_number().over(w) + 1)
    steps = push.groupBy("slug", "from_k").count()
    cum = steps.select(
        "slug", "from_k",
        F.sum("count").over(Window.partitionBy("slug").orderBy("from_k")).alias("shift"),
        F.lead("from_k").over(Window.partitionBy("slug").orderBy("from_k")).alias("to_k"),
    )
    hit = (F.col("k") >= F.col("from_k")) & (F.col("to_k").isNull() | (F.col("k") < F.col("to_k")))
    n = F.col("k") + F.coalesce("shift", F.lit(0))
    return (
        want.join(cum, (want["slug"] == cum["slug"]) & hit, "left")
        .select(want["seq"], want["name"], want["slug"], "family", n.alias("n"))
        .select("seq", "name", "slug", "family", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string"))).alias("id"))
    )
