"""Relations between units, doors, occupants, cameras and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g, labels, sight
from ..session import cut
from .spatial import FLOOR, box_join, box_tiles, number_rows, points_in_boxes, tile, with_box

PROBE_M = 0.4


def containing_units(points: DataFrame, units: DataFrame, point_id: str) -> DataFrame:
    """Every (point, unit) with the point inside the unit."""
    u = with_box(units.select(*FLOOR, "unit_id", F.col("pos").alias("unit_pos"), "polygon"))
    return points_in_boxes(points, u, point_id).where(
        sight.ring_holds(F.col("at"), F.col("polygon"))
    )


def smallest_unit(points: DataFrame, units: DataFrame, point_id: str) -> DataFrame:
    """The smallest unit around each point; earlier units win ties."""
    return (
        containing_units(points, units, point_id)
        .withColumn("area", g.polygon_area(F.col("polygon")))
        .groupBy(*FLOOR, point_id)
        .agg(F.min_by("unit_id", F.struct("area", "unit_pos", "unit_id")).alias("unit_id"))
    )


def first_unit(points: DataFrame, units: DataFrame, point_id: str) -> DataFrame:
    return (
        containing_units(points, units, point_id)
        .groupBy(*FLOOR, point_id)
        .agg(F.min_by("unit_id", "unit_pos").alias("unit_id"))
    )


def occupant_names(occupants: DataFrame) -> DataFrame:
    """Space-joined tenant names per unit, in array order."""
    return (
        occupants.groupBy("building_id", "unit_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("o"))
        .select("building_id", "unit_id", F.concat_ws(" ", "o.name").alias("names"))
    )


def occupant_anchors(occupants: DataFrame, units: DataFrame) -> DataFrame:
    c = units.select(
        "building_id", "unit_id", "ordinal", g.polygon_centroid(F.col("polygon")).alias("centroid")
    )
    return (
        occupants.join(c, ["building_id", "unit_id"], "left")
        .withColumn("at", F.coalesce("anchor", "centroid", g.pt(0, 0)))
        .drop("centroid")
    )


def vacant_units(units: DataFrame, occupants: DataFrame) -> DataFrame:
    return units.where(labels.is_indoor_space(F.col("category"))).join(
        occupants, ["building_id", "unit_id"], "left_anti"
    )


def first_corridors(units: DataFrame) -> DataFrame:
    """The hub of each floor: its first corridor."""
    return (
        units.where("category = 'corridor'")
        .groupBy(*FLOOR)
        .agg(F.min_by(F.struct("unit_id", "polygon", "security"), "pos").alias("hall"))
    )


def doors_for_rooms(rooms: DataFrame, units: DataFrame) -> DataFrame:
    """A door per room on the corridor's edge, x clamped to the corridor;
    rooms on floors without a corridor drop out."""
    h, r = g.bbox(F.col("hall.polygon")), g.bbox(F.col("polygon"))
    x = F.least(F.greatest((r["x0"] + r["x1"]) / 2, h["x0"]), h["x1"])
    y = F.when((r["y1"] > h["y0"]) & (r["y0"] >= h["y1"]), h["y1"]).otherwise(h["y0"])
    return rooms.join(first_corridors(units), FLOOR).select(*FLOOR, "unit_id", g.pt(x, y).alias("at"))


def auto_doors(units: DataFrame, openings: DataFrame) -> DataFrame:
    """Doors for every doorless indoor space on floors with a corridor."""
    doorless = units.where(labels.is_indoor_space(F.col("category"))).join(
        openings, ["building_id", "unit_id"], "left_anti"
    )
    return doors_for_rooms(doorless, units)


def nearest_edge(openings: DataFrame, units: DataFrame) -> DataFrame:
    """Each opening with its host unit and the host edge nearest to it."""
    host = units.select(
        *FLOOR, "unit_id", "category", "security", "polygon", F.col("name").alias("unit_name")
    )
    p = F.col("at")
    cand = F.transform(
        g.ring_edges(F.col("polygon")),
        lambda e: F.struct(
            g.seg_dist(p["x"], p["y"], e["ax"], e["ay"], e["bx"], e["by"]).alias("d"),
            e["i"].alias("i"),
            e.alias("e"),
        ),
    )
    return openings.join(host, ["building_id", "unit_id"]).withColumn("edge", F.array_min(cand)["e"])


def door_adjacency(openings: DataFrame, units: DataFrame) -> DataFrame:
    """Opening -> owner and the unit across the wall (NULL when one-sided)."""
    e = F.col("edge")
    ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
    ln = g.hypot(ex, ey)
    ln = F.when(ln == 0, F.lit(1.0)).otherwise(ln)
    nx, ny = -ey / ln * PROBE_M, ex / ln * PROBE_M
    at = F.col("at")
    sides = (
        nearest_edge(openings, units)
        .select(
            *FLOOR,
            "opening_id",
            F.col("unit_id").alias("owner"),
            F.col("polygon").alias("own"),
            F.posexplode(
                F.array(g.pt(at["x"] + nx, at["y"] + ny), g.pt(at["x"] - nx, at["y"] - ny))
            ).alias("side", "at"),
        )
        .where(~g.point_in_ring(F.col("at"), F.col("own")))
        .drop("own")
    )
    hit = (
        containing_units(sides, units, "opening_id")
        .where("unit_id != owner")
        .groupBy("building_id", "opening_id")
        .agg(F.min_by("unit_id", F.struct("side", "unit_pos")).alias("other"))
    )
    return (
        openings.select("building_id", "opening_id", F.col("unit_id").alias("owner"), "kind", "at")
        .join(hit, ["building_id", "opening_id"], "left")
    )


def badge_readers(openings: DataFrame, units: DataFrame) -> DataFrame:
    guarded = units.where("security in ('secure', 'restricted')").select(
        *FLOOR, "unit_id", "security"
    )
    return openings.join(guarded, ["building_id", "unit_id"])


def snap_points(
    points: DataFrame, units: DataFrame, tol: float, point_id: str, grid: float | None = None,
    prev: str | None = None,
) -> DataFrame:
    """Nearest vertex within tol, else nearest edge point, else alignment with
    `prev`, else the grid. Adds `snapped` and `snap_kind`."""
    p = F.col("at")
    edges = units.select(*FLOOR, "pos", F.inline(g.ring_edges(F.col("polygon")))).select(
        *FLOOR,
        F.struct("pos", "i").alias("seq"),
        F.struct("ax", "ay", "bx", "by").alias("e"),
        F.struct(
            (F.least("ax", "bx") - tol).alias("x0"), (F.least("ay", "by") - tol).alias("y0"),
            (F.greatest("ax", "bx") + tol).alias("x1"), (F.greatest("ay", "by") + tol).alias("y1"),
        ).alias("box"),
    )
    e = F.col("e")
    dv = g.hypot(p["x"] - e["ax"], p["y"] - e["ay"])
    de = g.seg_dist(p["x"], p["y"], e["ax"], e["ay"], e["bx"], e["by"])
    foot = g.project_on_segment(p, g.pt(e["ax"], e["ay"]), g.pt(e["bx"], e["by"]))
    near = (
        points_in_boxes(points.select(*FLOOR, point_id, "at"), edges, point_id)
        .withColumns({"dv": dv, "de": de, "foot": foot})
        .groupBy(*FLOOR, point_id)
        .agg(
            F.min(F.when(F.col("dv") <= tol, F.struct("dv", "seq", g.pt(e["ax"], e["ay"]).alias("q")))).alias("v"),
            F.min(F.when(F.col("de") <= tol, F.struct("de", "seq", F.col("foot").alias("q")))).alias("s"),
        )
    )
    out = points.join(near, [*FLOOR, point_id], "left")
    kind = F.when(F.col("v").isNotNull(), "vertex").when(F.col("s").isNotNull(), "edge")
    spot = F.when(F.col("v").isNotNull(), F.col("v.q")).when(F.col("s").isNotNull(), F.col("s.q"))
    if prev is not None:
        q = F.col(prev)
        ax = F.coalesce(F.abs(p["x"] - q["x"]) <= tol, F.lit(False))
        ay = F.coalesce(F.abs(p["y"] - q["y"]) <= tol, F.lit(False))
        aligned = g.pt(F.when(ax, q["x"]).otherwise(p["x"]), F.when(ay, q["y"]).otherwise(p["y"]))
        kind, spot = kind.when(ax | ay, "axis"), spot.when(ax | ay, aligned)
    if grid is not None and grid > 0:
        return out.withColumns(
            {"snap_kind": kind.otherwise("grid"), "snapped": spot.otherwise(g.snap_point(p, grid))}
        ).drop("v", "s")
    return out.withColumns(
        {"snap_kind": kind.otherwise("none"), "snapped": spot.otherwise(p)}
    ).drop("v", "s")


def live_view_cameras(views: DataFrame, cameras: DataFrame) -> DataFrame:
    """Saved views -> their cameras that exist on the view's floor, in order."""
    rows = views.select(
        *FLOOR, "view_id", "name", F.posexplode("camera_ids").alias("seq", "camera_id")
    )
    return rows.join(cameras.select(*FLOOR, "camera_id"), [*FLOOR, "camera_id"], "left_semi")


def cameras_by_space(cameras: DataFrame, units: DataFrame) -> DataFrame:
    """Cameras with their smallest containing space (no space: dropped)."""
    pts = cameras.select(*FLOOR, "camera_id", "at")
    return smallest_unit(pts, units, "camera_id")


def camera_walls(cameras, units, levels, views) -> DataFrame:
    """All / room / saved groups of cameras, one row per (group, camera)."""
    lv = levels.select(*FLOOR, F.col("name").alias("level"))
    everything = cameras.join(lv, FLOOR, "left").select(
        *FLOOR, F.lit("all").alias("wall_kind"), F.lit("all").alias("wall_id"),
        F.concat(F.lit("All · "), F.coalesce("level", F.concat(F.lit("L"), "ordinal"))).alias("name"),
        "camera_id", F.col("pos").alias("seq"),
    )
    rooms = (
        cameras_by_space(cameras, units)
        .join(units.select("building_id", "unit_id", "name"), ["building_id", "unit_id"])
        .join(cameras.select("building_id", "camera_id", F.col("pos").alias("seq")), ["building_id", "camera_id"])
        .select(
            *FLOOR, F.lit("room").alias("wall_kind"),
            F.concat(F.lit("room:"), "unit_id").alias("wall_id"), "name", "camera_id", "seq",
        )
    )
    saved = live_view_cameras(views, cameras).select(
        *FLOOR, F.lit("saved").alias("wall_kind"),
        F.concat(F.lit("saved:"), "view_id").alias("wall_id"), "name", "camera_id", "seq",
    )
    return everything.unionByName(rooms).unionByName(saved)


def camera_rail(cameras, units, levels, views) -> DataFrame:
    """(floor keys, place, wall_kind, wall_id, name, cameras): the walls of each
    floor in order. All cameras come first, then rooms with cameras, most of them
    first and then by name, then every saved view of the building in its order,
    with the cameras of it that are on this floor."""
    walls = camera_walls(cameras, units, levels, views).where("wall_kind != 'saved'")
    counted = walls.groupBy(*FLOOR, "wall_kind", "wall_id", "name").agg(F.count("*").alias("cameras"))
    name = F.concat(F.lit("All · "), F.coalesce("name", F.concat(F.lit("L"), "ordinal")))
    every = levels.join(counted.where("wall_kind = 'all'").select(*FLOOR, "cameras"), FLOOR, "left").select(
        *FLOOR, F.lit("all").alias("wall_kind"), F.lit("all").alias("wall_id"), name.alias("name"), F.coalesce("cameras", F.lit(0)).alias("cameras"), F.lit(0).alias("pos")
    )
    rooms = counted.where("wall_kind = 'room'").withColumn("pos", F.lit(0))
    live = views.select("building_id", "view_id", F.explode("camera_ids").alias("camera_id")).join(cameras.select(*FLOOR, "camera_id"), ["building_id", "camera_id"])
    live = live.groupBy(*FLOOR, "view_id").agg(F.count("*").alias("cameras"))
    saved = (
        levels.select(*FLOOR).join(views.select("building_id", "view_id", "name", "pos"), "building_id").join(live, [*FLOOR, "view_id"], "left")
        .select(*FLOOR, F.lit("saved").alias("wall_kind"), F.concat(F.lit("saved:"), "view_id").alias("wall_id"), "name", F.coalesce("cameras", F.lit(0)).alias("cameras"), "pos")
    )
    kind = F.when(F.col("wall_kind") == "all", 0).when(F.col("wall_kind") == "room", 1).otherwise(2)
    size = F.when(F.col("wall_kind") == "room", -F.col("cameras")).otherwise(F.lit(0))
    order = Window.partitionBy(*FLOOR).orderBy(kind, size, "pos", "name", "wall_id")
    return every.unionByName(rooms).unionByName(saved).withColumn("place", F.row_number().over(order)).drop("pos")


def units_without_camera(units: DataFrame, cameras: DataFrame) -> DataFrame:
    held = containing_units(cameras.select(*FLOOR, "camera_id", "at"), units, "camera_id")
    return units.join(held, [*FLOOR, "unit_id"], "left_anti")


def heading_gap(a, b):
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def duplicate_cameras(
    candidates: DataFrame, cameras: DataFrame, within_m: float = 1.5, within_deg: float = 25.0
) -> DataFrame:
    """Candidates that repeat an existing camera's place and aim."""
    old = cameras.select(
        *FLOOR, F.col("at").alias("old_at"), F.col("heading").alias("old_heading"),
        F.struct(
            (F.col("at.x") - within_m).alias("x0"), (F.col("at.y") - within_m).alias("y0"),
            (F.col("at.x") + within_m).alias("x1"), (F.col("at.y") + within_m).alias("y1"),
        ).alias("box"),
    )
    close = g.dist(F.col("at"), F.col("old_at")) <= within_m
    same = heading_gap(F.col("heading"), F.col("old_heading")) <= within_deg
    return (
        points_in_boxes(candidates, old, "candidate_id", size=4.0)
        .where(close & same)
        .select(*FLOOR, "candidate_id")
        .distinct()
    )


def nearest_cameras(
    points: DataFrame, cameras: DataFrame, point_id: str, k: int = 8, cell: float = 16.0,
) -> DataFrame:
    """The k nearest cameras of the same floor, ties by `pos`.

    Cameras and points are hashed to tiles; each round looks one doubling of
    the radius further, and a point is done once its k-th camera lies within
    the radius searched. The radius doubles until it spans the floor, where
    every camera is found, so rounds end by themselves.
    """
    cams = cameras.select(*FLOOR, "camera_id", F.col("pos").alias("cam_pos"), F.col("at").alias("cam_at"))
    extent = cams.groupBy(*FLOOR).agg(
        F.count("*").alias("n_cams"),
        F.struct(
            F.min("cam_at.x").alias("x0"), F.min("cam_at.y").alias("y0"),
            F.max("cam_at.x").alias("x1"), F.max("cam_at.y").alias("y1"),
        ).alias("extent"),
    )
    e, at = F.col("extent"), F.col("at")
    area = F.greatest((e["x1"] - e["x0"]) * (e["y1"] - e["y0"]), F.lit(1.0))
    open_pts = points.join(extent, FLOOR).withColumn(
        "radius", F.sqrt(area * k / F.col("n_cams")) * 2 + 1.0
    )
    done = None
    while True:
        r = F.col("radius")
        boxed = open_pts.withColumn(
            "lbox",
            F.struct(
                F.greatest(at["x"] - r, e["x0"]).alias("x0"), F.greatest(at["y"] - r, e["y0"]).alias("y0"),
                F.least(at["x"] + r, e["x1"]).alias("x1"), F.least(at["y"] + r, e["y1"]).alias("y1"),
            ),
        )
        tiles = box_tiles(boxed, "lbox", cell).drop("tx0", "ty0", "lbox")
        hashed = cams.withColumns({"tx": tile(F.col("cam_at.x"), cell), "ty": tile(F.col("cam_at.y"), cell)})
        d2 = (at["x"] - F.col("cam_at.x")) * (at["x"] - F.col("cam_at.x")) + (
            at["y"] - F.col("cam_at.y")
        ) * (at["y"] - F.col("cam_at.y"))
        w = Window.partitionBy(*FLOOR, point_id).orderBy("d2", "cam_pos")
        ranked = (
            tiles.join(hashed, [*FLOOR, "tx", "ty"])
            .withColumn("d2", d2)
            .where(F.col("d2") <= r * r)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
        )
        found = ranked.groupBy(*FLOOR, point_id).agg(F.max("rank").alias("got"))
        need = F.least(F.lit(k), F.col("n_cams"))
        state = open_pts.join(found, [*FLOOR, point_id], "left")
        short = state.where(F.coalesce("got", F.lit(0)) < need)
        rows = ranked.join(short, [*FLOOR, point_id], "left_anti").select(
            *FLOOR, point_id, "camera_id", "cam_pos", F.sqrt("d2").alias("distance_m"), "rank"
        )
        done = rows if done is None else done.unionByName(rows)
        short = cut(short)
        if short.limit(1).count() == 0:
            return done
        open_pts = short.drop("got").withColumn("radius", F.col("radius") * 2)


def default_names(new_units: DataFrame, units: DataFrame) -> DataFrame:
    """"<Label> n" for new units, counting on from the category's units."""
    have = units.groupBy("building_id", "category").agg(F.count("*").alias("have"))
    return (
        number_rows(new_units, ["building_id", "category"], "pos", "n")
        .join(have, ["building_id", "category"], "left")
        .withColumn(
            "name",
            F.concat_ws(
                " ",
                labels.lookup(labels.CATEGORY_LABELS, F.col("category")),
                (F.coalesce("have", F.lit(0)) + F.col("n")).cast("string"),
            ),
        )
        .drop("have", "n")
    )


def placeholder_names(new: DataFrame, existing: DataFrame, keys: list[str], word: str, pos: str = "pos", ties: list[str] | None = None) -> DataFrame:
    """``new`` with a ``name`` "<word> n", counting on by ``pos`` from the rows
    of ``existing`` with the same keys; a key without any counts from 1. ``pos``
    is a number; ``new`` has no columns ``n`` and ``have``."""
    have = existing.groupBy(*keys).agg(F.count("*").alias("have"))
    return (
        number_rows(new, keys, pos, "n", ties=ties)
        .join(have, keys, "left")
        .withColumn("name", F.concat_ws(" ", F.lit(word), (F.coalesce("have", F.lit(0)) + F.col("n")).cast("string")))
        .drop("have", "n")
    )


def camera_names(new: DataFrame, cameras: DataFrame, pos: str = "pos") -> DataFrame:
    """"Camera n" for cameras put on a floor, after those it has."""
    return placeholder_names(new, cameras, FLOOR, "Camera", pos)


def patrol_names(new: DataFrame, patrols: DataFrame) -> DataFrame:
    """"Auto patrol n" for tours, floor by floor after the patrols of their
    building, whatever those are called; at most one new tour a floor."""
    return placeholder_names(new, patrols, ["building_id"], "Auto patrol", "ordinal")


def unit_overlaps(shapes: DataFrame, key: str, units: DataFrame) -> DataFrame:
    """Shape-unit pairs that share area on the same floor."""
    left = shapes.select(*FLOOR, key, F.col("polygon").alias("shape"), g.bbox(F.col("polygon")).alias("lbox"))
    right = units.select(*FLOOR, "unit_id", "polygon", g.bbox(F.col("polygon")).alias("rbox"))
    return box_join(left, right).where(sight.rings_overlap(F.col("shape"), F.col("polygon"))).select(
        *FLOOR, key, "unit_id"
    )
