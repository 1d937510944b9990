"""Edits as data: set-based upserts with their cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g
from . import places
from .spatial import FLOOR, number_rows


def ensure_numbers(cameras: DataFrame) -> DataFrame:
    """Give unnumbered cameras call-up numbers above the building's highest;
    numbers already given never change."""
    top = cameras.groupBy("building_id").agg(F.coalesce(F.max("op_number"), F.lit(0)).alias("top"))
    bare = number_rows(cameras.where("op_number is null"), ["building_id"], "pos", "n")
    filled = (
        bare.join(top, "building_id")
        .withColumn("op_number", (F.col("top") + F.col("n")).cast("int"))
        .drop("top", "n")
    )
    return cameras.where("op_number is not null").unionByName(filled)


def latest(log: DataFrame) -> DataFrame:
    """Last value per (building, entity, id, field) by (ts, seq)."""
    key = ["building_id", "entity", "id", "field"]
    return log.groupBy(*key).agg(
        F.max_by(F.struct("value"), F.struct("ts", "seq")).alias("v")
    ).select(*key, "v.value")


CLAMPS = {
    ("levels", "ceiling_m"): lambda v: F.least(F.greatest(v, F.lit(2.2)), F.lit(8.0)),
    ("cameras", "heading"): lambda v: F.pmod(v, F.lit(360.0)),
}


def apply_edits(table: DataFrame, entity: str, key: str, log: DataFrame) -> DataFrame:
    """Upsert of the newest value of each edited field of `table`. Values are
    JSON text; a field edited to null becomes null."""
    types = {f.name: f.dataType for f in table.schema.fields}
    fields = [c for c in table.columns if c not in ("building_id", "ordinal", key)]
    mine = latest(log.where(F.col("entity") == entity).where(F.col("field").isin(fields)))
    wide = mine.groupBy("building_id", F.col("id").alias(key)).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("patch")
    )

    def value(name):
        raw = F.try_element_at("patch", F.lit(name))
        typed = F.from_json(
            F.concat(F.lit('{"v":'), raw, F.lit("}")), f"v {types[name].simpleString()}"
        )["v"]
        clamp = CLAMPS.get((entity, name))
        return clamp(typed) if clamp else typed

    has = lambda n: F.coalesce(F.map_contains_key("patch", F.lit(n)), F.lit(False))
    return table.join(wide, ["building_id", key], "left").select(
        *[F.when(has(c), value(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns]
    )


def delete_rows(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("building_id", key), ["building_id", key], "left_anti")


def bulk_set(units: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    """Set category or security of many units (ids: building_id, unit_id)."""
    hit = ids.select("building_id", "unit_id").distinct().withColumn("_hit", F.lit(True))
    return units.join(hit, ["building_id", "unit_id"], "left").select(
        *[F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in units.columns]
    )


def fill_unrated(cameras: DataFrame, floor: DataFrame, kind: str, model: DataFrame) -> DataFrame:
    """Give unrated cameras of a kind on the chosen floors the optics of one
    catalogue row; of several the one of the first label."""
    fields = ("label", "fov_deg", "resolution_mp", "range_m")
    spec = model.where("label is not null").agg(F.min(F.struct(*fields)).alias("spec")).scalar()
    pick = floor.select(*FLOOR).distinct().withColumn("_on", F.lit(True))
    hit = (F.col("kind") == kind) & (F.coalesce("resolution_mp", F.lit(0.0)) == 0) & F.col("_on") & F.col("_spec").isNotNull()
    new = {"model": "label", "fov_deg": "fov_deg", "resolution_mp": "resolution_mp", "range_m": "range_m"}
    return cameras.join(pick, FLOOR, "left").withColumn("_spec", spec).select(
        *[F.when(hit, F.col(f"_spec.{new[c]}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cameras.columns]
    )


def add_rooms(rooms: DataFrame, units: DataFrame, openings: DataFrame) -> dict[str, DataFrame]:
    """rooms(building_id, ordinal, unit_id, pos, category, polygon): named
    "<Label> n", given a door; a new corridor also doors the floor's doorless
    rooms."""
    named = places.default_names(rooms, units).withColumn("security", F.lit(None).cast("string"))
    all_units = units.unionByName(named.select(*units.columns))
    direct = places.doors_for_rooms(named, units)
    retro_floors = rooms.where("category = 'corridor'").select(*FLOOR).distinct()
    have = openings.select("building_id", "unit_id").unionByName(direct.select("building_id", "unit_id"))
    retro = places.auto_doors(all_units.join(retro_floors, FLOOR, "left_semi"), have)
    doors = direct.unionByName(retro).select(
        "building_id", F.concat(F.lit("d-"), "unit_id").alias("opening_id"), "unit_id", "at"
    )
    return {"units": all_units, "openings": openings.unionByName(doors, allowMissingColumns=True)}


def add_openings(ids: DataFrame, units: DataFrame) -> DataFrame:
    """A door for each named unit: on the corridor's edge, else the middle of
    the unit's first edge."""
    u = units.join(ids.select("building_id", "unit_id"), ["building_id", "unit_id"], "left_semi")
    a, b = F.get("polygon", F.lit(0)), F.get("polygon", F.lit(1))
    auto = places.doors_for_rooms(u, units).withColumnRenamed("at", "auto")
    return u.join(auto, [*FLOOR, "unit_id"], "left").select(
        "building_id", "unit_id",
        F.coalesce("auto", g.pt((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)).alias("at"),
    )


def link_floors(links: DataFrame, units: DataFrame, verticals: DataFrame) -> dict[str, DataFrame]:
    """links(building_id, unit_a, unit_b, name, pos): new undirected pairs on
    different floors; both ends take the category of the link."""
    pair = lambda d: d.withColumns(
        {"lo": F.least("unit_a", "unit_b"), "hi": F.greatest("unit_a", "unit_b")}
    )
    at = lambda s: units.select("building_id", F.col("unit_id").alias(f"unit_{s}"), F.col("ordinal").alias(f"o_{s}"))
    fresh = (
        pair(links).join(pair(verticals).select("building_id", "lo", "hi"), ["building_id", "lo", "hi"], "left_anti")
        .join(at("a"), ["building_id", "unit_a"]).join(at("b"), ["building_id", "unit_b"]).where("o_a != o_b")
        .groupBy("building_id", "lo", "hi")
        .agg(F.min_by(F.struct("unit_a", "unit_b", "name", "pos"), "pos").alias("l"))
        .select("building_id", "l.*")
    )
    cat = F.when(F.col("name").isin("Stairs", "Escalator"), "stairs").otherwise("elevator")
    ends = fresh.select(
        "building_id", "pos", cat.alias("cat"), F.explode(F.array("unit_a", "unit_b")).alias("unit_id")
    ).groupBy("building_id", "unit_id").agg(F.max_by("cat", "pos").alias("cat"))
    new_units = units.join(ends, ["building_id", "unit_id"], "left").select(
        *[F.coalesce("cat", "category").alias(c) if c == "category" else F.col(c) for c in units.columns]
    )
    return {"units": new_units, "verticals": verticals.unionByName(fresh.select(*verticals.columns))}


def move_occupants(occupants: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(building_id, occupant_id, unit_id, seq): the newest move of each
    occupant gives its unit and clears its anchor."""
    m = _newest(moves, ["building_id", "occupant_id"]).select("building_id", "occupant_id", F.col("unit_id").alias("_to"))
    return occupants.join(m, ["building_id", "occupant_id"], "left").select(
        *[
            F.coalesce("_to", "unit_id").alias(c) if c == "unit_id"
            else F.when(F.col("_to").isNull(), F.col("anchor")).alias(c) if c == "anchor"
            else F.col(c)
            for c in occupants.columns
        ]
    )


def place_anchors(anchors: DataFrame, units: DataFrame) -> DataFrame:
    """anchors(building_id, occupant_id, unit_id, at): a point dragged outside
    its unit moves to the nearest boundary point."""
    return anchors.join(units.select("building_id", "unit_id", "polygon"), ["building_id", "unit_id"], "left").select(
        "building_id", "occupant_id",
        F.when(
            F.col("polygon").isNull() | g.point_in_ring(F.col("at"), F.col("polygon")), F.col("at")
        ).otherwise(g.nearest_on_polygon(F.col("at"), F.col("polygon"))).alias("anchor"),
    )


def move_vertex(ring, index, p):
    return F.transform(ring, lambda v, i: F.when(i == index, p).otherwise(v))


def delete_vertex(ring, index):
    """Rings keep at least three points."""
    return F.when(F.size(ring) > 3, F.filter(ring, lambda v, i: i != index)).otherwise(ring)


def insert_vertex(ring, edge, p):
    return F.concat(F.slice(ring, F.lit(1), edge + 1), F.array(p), F.slice(ring, edge + 2, F.size(ring)))


def round_column(structures: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(building_id, structure_id, center, radius_m, seq): outlines follow
    the newest edit of each column."""
    edits = _newest(edits, ["building_id", "structure_id"]).select("building_id", "structure_id", "center", "radius_m")
    return structures.join(edits, ["building_id", "structure_id"], "left").select(
        *[
            F.when(F.col("center").isNotNull(), g.column_polygon(F.col("center"), F.col("radius_m"))).otherwise(F.col(c)).alias(c)
            if c == "polygon" else F.col(c)
            for c in structures.columns
        ]
    )


def free_slots(presets: DataFrame) -> DataFrame:
    """Lowest free slot 2-9 per camera; slot 1 is Home; NULL when full."""
    return presets.groupBy("building_id", "camera_id").agg(
        F.array_min(F.array_except(F.sequence(F.lit(2), F.lit(9)), F.collect_set("slot"))).alias("slot")
    )


def _newest(edits: DataFrame, key: list[str]) -> DataFrame:
    """One edit per key: the one of the highest `seq`. Without the column the
    edits of a key are ordered by their own values."""
    rest = [c for c in edits.columns if c not in key]
    order = F.struct(*(["seq"] if "seq" in rest else []), *[c for c in rest if c != "seq"])
    return edits.groupBy(*key).agg(F.max(order).alias("_e")).select(*key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def save_presets(cameras: DataFrame, presets: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(building_id, camera_id, name, seq): current aim saved in a free
    slot, the n-th ask of a camera in its n-th free one; asks beyond the last
    slot save nothing."""
    camera = ["building_id", "camera_id"]
    open_slots = asks.select(*camera).distinct().join(
        presets.groupBy(*camera).agg(F.collect_set("slot").alias("used")), camera, "left"
    ).select(
        *camera,
        F.posexplode(F.array_except(F.sequence(F.lit(2), F.lit(9)), F.coalesce("used", F.array().cast("array<int>")))).alias("n", "slot"),
    )
    order = Window.partitionBy(*camera).orderBy(*(["seq"] if "seq" in asks.columns else []), "name")
    numbered = asks.withColumn("n", F.row_number().over(order) - 1)
    c = cameras.select("building_id", "camera_id", "heading", F.coalesce("tilt_deg", F.lit(0.0)).alias("tilt_deg"), "fov_deg", "range_m")
    new = (
        numbered.join(open_slots, [*camera, "n"]).join(c, camera)
        .withColumn("name", F.when(F.trim("name") != "", F.trim("name")).otherwise(F.concat_ws(" ", F.lit("Preset"), F.col("slot").cast("string"))))
    )
    return presets.unionByName(new.select(*presets.columns))


def recall_presets(cameras: DataFrame, presets: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(building_id, camera_id, slot, seq): cameras take the aim of the
    newest preset asked for that exists."""
    named = asks.join(presets.select("building_id", "camera_id", "slot"), ["building_id", "camera_id", "slot"], "left_semi")
    p = _newest(named, ["building_id", "camera_id"]).join(presets, ["building_id", "camera_id", "slot"]).select(
        "building_id", "camera_id", F.struct(F.pmod("heading", F.lit(360.0)).alias("heading"), "tilt_deg", "fov_deg", "range_m").alias("p")
    )
    aim = ("heading", "tilt_deg", "fov_deg", "range_m")
    return cameras.join(p, ["building_id", "camera_id"], "left").select(
        *[F.coalesce(f"p.{c}", c).alias(c) if c in aim else F.col(c) for c in cameras.columns]
    )


def home_presets(aims: DataFrame, cameras: DataFrame, presets: DataFrame) -> DataFrame:
    """Home (slot 1) for every camera that is aimed and has none yet: the
    authored aim, captured before the first move."""
    moved = aims.select("building_id", "camera_id").distinct()
    has = presets.where("slot = 1").select("building_id", "camera_id")
    return (
        cameras.join(moved, ["building_id", "camera_id"], "left_semi").join(has, ["building_id", "camera_id"], "left_anti")
        .select("building_id", "camera_id", F.lit(1).alias("slot"), F.lit("Home").alias("name"), "heading",
                F.coalesce("tilt_deg", F.lit(0.0)).alias("tilt_deg"), "fov_deg", "range_m")
    )


def view_add(ids, camera):
    return F.when(F.array_contains(ids, camera), ids).otherwise(F.array_append(ids, camera))


def view_move(ids, camera, step):
    """Swap a camera with its neighbour; out of range leaves the view alone."""
    i = F.array_position(ids, camera).cast("int") - 1
    j = i + step
    ok = (i >= 0) & (j >= 0) & (j < F.size(ids))
    swapped = F.transform(ids, lambda v, k: F.when(k == i, F.get(ids, j)).when(k == j, F.get(ids, i)).otherwise(v))
    return F.when(ok, swapped).otherwise(ids)


def coalesce_edits(log: DataFrame, gap_ms: int = 2500) -> DataFrame:
    """Undo-sized units per user: an edit folds into the one before it when
    that one has the same key and lies less than the gap back."""
    w = Window.partitionBy("user_id").orderBy("ts", "seq")
    near = (F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w))) < gap_ms
    fold = F.coalesce(near & (F.lag("edit_key").over(w) == F.col("edit_key")), F.lit(False))
    return log.withColumn("fresh", (~fold).cast("int")).withColumn("undo_unit", F.sum("fresh").over(w)).drop("fresh")
