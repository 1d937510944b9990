"""Camera suggestions: corner mounts in rooms without a camera, then greedy
filling of what no camera sees, on all floors at once.

Corner mounts don't depend on coverage, so they are one table; of mounts that
repeat each other the first of a floor's order stays. Filling is greedy and goes
by rounds. A round looks at the next `FIRST` seeds of every floor that is not
done, and where all fail at twice as many, up to `AHEAD`: those that would follow
if the ones before were given up. Up to 15 poses a seed are tried through the
walls, and the first seed with a pose that recovers enough is taken; the ones
before it are given up for good. So the result is that of one step after the
other, in fewer rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g
from ..operators.coverage import coverage, grid_cells
from ..operators.places import duplicate_cameras, heading_gap, units_without_camera
from ..operators.spatial import FLOOR, box_tiles, once, points_in_boxes, split_hot
from ..operators.visibility import visibility
from ..operators.walls import first_footprints
from ..session import cut, stored

# Fixed values of the planner.
SKIPPED = ("stairs", "elevator", "outside")
LEAST_UNIT_M2, LEAST_MOUNT_M2, LEAST_SEEN_M2 = 20.0, 25.0, 15.0
MOUNT_STEPS_M2 = (120.0, 400.0, 1200.0)
MOUNT_INSET_M, MOUNT_FOV, MOUNT_RANGE_M = 1.3, 100.0, (16.0, 50.0)
GRID_M, GRID_POINTS = (1.25, 4.0), 2500
DENSE_M, AIM_M = 14.0, 22.0
OFFSETS = ((0.7, 0.7), (-1.3, 0.9), (1.1, -1.1), (-0.9, -0.7), (2.3, 1.7))
TURNS = (0.0, 40.0, -40.0)
FILL_FOV, FILL_RANGE_M = 110.0, 45.0
LEAST_GAIN, GAIN_SHARE = 2, 0.15
SAME_M, SAME_DEG = 1.5, 25.0
#: Side of the tiles in which points and rings meet.
ROW_TILE_M = 64.0
#: Steps of a floor that one round looks ahead, at first and at most.
FIRST, AHEAD = 4, 8


def eligible(units: DataFrame) -> DataFrame:
    return units.where(~F.col("category").isin(*SKIPPED) & (F.size("polygon") >= 3)).withColumn("area", g.polygon_area(F.col("polygon"))).where(F.col("area") >= LEAST_UNIT_M2)


def region(units: DataFrame, footprints: DataFrame) -> DataFrame:
    """What is to be seen of a floor: its outline, or its eligible units."""
    fp = first_footprints(footprints)
    loose = eligible(units).join(fp.select(*FLOOR), FLOOR, "left_anti")
    return fp.select(*FLOOR, F.lit("footprint").alias("shape_id"), "polygon").unionByName(loose.select(*FLOOR, F.col("unit_id").alias("shape_id"), "polygon"))


def rounded(poses: DataFrame) -> DataFrame:
    """Poses as they are mounted: tenths of a metre and whole degrees."""
    tenth = lambda v: g.round_half_up(v * 10) / 10
    return poses.withColumns({
        "raw_at": F.col("at"), "raw_heading": F.col("heading"),
        "at": g.pt(tenth(F.col("at.x")), tenth(F.col("at.y"))),
        "heading": F.pmod(g.round_half_up(F.col("heading") + 360), F.lit(360.0)),
    })


def as_cameras(poses: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return poses.select(
        *FLOOR, F.col("candidate_id").alias("camera_id"), "at", "heading", "fov_deg", "range_m", F.lit("fixed").alias("kind"),
        none.alias("tilt_deg"), none.alias("mount_m"), none.alias("vfov_deg"),
    )


def seeing(poses: DataFrame, walls: DataFrame) -> DataFrame:
    """Mounted poses that see enough, with their rings."""
    here = walls.join(poses.select(*FLOOR).distinct(), FLOOR, "left_semi")
    rings = visibility(as_cameras(poses), here).withColumnRenamed("camera_id", "candidate_id")
    sees = (F.size("ring") >= 3) & (g.polygon_area(F.col("ring")) >= LEAST_SEEN_M2)
    return poses.join(once(rings, sees=sees).where("sees").drop("sees"), [*FLOOR, "candidate_id"])


def corner_poses(units: DataFrame, cameras: DataFrame) -> DataFrame:
    """One to four mounts near corners of each eligible room without a camera,
    aimed at the room's middle; `nth` is their order on the floor."""
    rooms = units_without_camera(eligible(units), cameras).where(F.col("area") >= LEAST_MOUNT_M2)
    a, n = F.col("area"), F.size("polygon")
    wanted = sum((F.when(a >= m, 1).otherwise(0) for m in MOUNT_STEPS_M2), F.lit(1))
    rooms = rooms.withColumns({"k": F.least(wanted, n), "middle": g.vertex_mean(F.col("polygon"))})
    each = rooms.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    corner = F.get("polygon", F.pmod(F.floor(F.col("i") * (n / F.col("k"))).cast("int"), n))
    c, m = F.col("corner"), F.col("middle")
    d = g.hypot(m["x"] - c["x"], m["y"] - c["y"])
    inset = MOUNT_INSET_M / F.when(d > 0, d).otherwise(F.lit(1.0))
    each = each.withColumn("corner", corner).withColumn("at", g.pt(c["x"] + (m["x"] - c["x"]) * inset, c["y"] + (m["y"] - c["y"]) * inset))
    low, high = MOUNT_RANGE_M
    return each.select(
        *FLOOR, F.concat("unit_id", F.lit("/"), "i").alias("candidate_id"), (F.col("pos").cast("long") * 8 + F.col("i")).alias("nth"), F.col("name").alias("zone"), "at",
        F.degrees(F.atan2(m["y"] - F.col("at.y"), m["x"] - F.col("at.x"))).alias("heading"),
        F.lit(MOUNT_FOV).alias("fov_deg"), g.clamp(g.round_half_up(F.sqrt("area") * 1.7), low, high).alias("range_m"),
    )


def first_of_kind(poses: DataFrame) -> DataFrame:
    """In the order of `nth`, poses that repeat no pose kept before them: a pose
    stays when all earlier ones that it repeats are gone. Rounds go on until no
    pose is undecided; each settles the first of every group at least."""
    box = F.struct((F.col("at.x") - SAME_M).alias("x0"), (F.col("at.y") - SAME_M).alias("y0"), (F.col("at.x") + SAME_M).alias("x1"), (F.col("at.y") + SAME_M).alias("y1"))
    earlier = poses.select(*FLOOR, F.col("candidate_id").alias("first"), F.col("nth").alias("first_nth"), F.col("at").alias("first_at"), F.col("heading").alias("first_heading"), box.alias("box"))
    later = poses.select(*FLOOR, "candidate_id", "nth", F.col("raw_at").alias("at"), "raw_heading")
    near = points_in_boxes(later, earlier, "candidate_id", size=4.0)
    same = (g.dist(F.col("at"), F.col("first_at")) <= SAME_M) & (heading_gap(F.col("raw_heading"), F.col("first_heading")) <= SAME_DEG)
    clashes = cut(near.where((F.col("first_nth") < F.col("nth")) & same).select(*FLOOR, "first", "candidate_id"))
    open_ = cut(clashes.select(*FLOOR, "candidate_id").distinct())
    first = poses.join(open_, [*FLOOR, "candidate_id"], "left_anti")
    kept = first.select(*FLOOR, F.col("candidate_id").alias("first"))
    gone = kept.where("false")
    while not open_.isEmpty():
        lost = open_.join(clashes.join(kept, [*FLOOR, "first"], "left_semi"), [*FLOOR, "candidate_id"], "left_semi")
        gone = cut(gone.union(lost.select(*FLOOR, F.col("candidate_id").alias("first"))).distinct())
        open_ = open_.join(gone.withColumnRenamed("first", "candidate_id"), [*FLOOR, "candidate_id"], "left_anti")
        waits = clashes.join(gone, [*FLOOR, "first"], "left_anti").select(*FLOOR, "candidate_id")
        fresh = open_.join(waits, [*FLOOR, "candidate_id"], "left_anti")
        kept = cut(kept.union(fresh.select(*FLOOR, F.col("candidate_id").alias("first"))))
        open_ = cut(open_.join(fresh, [*FLOOR, "candidate_id"], "left_anti"))
    return poses.join(kept.withColumnRenamed("first", "candidate_id"), [*FLOOR, "candidate_id"], "left_semi")


def corner_mounts(units: DataFrame, cameras: DataFrame, walls: DataFrame, most: int) -> DataFrame:
    """(floor keys, candidate_id, nth, zone, at, heading, fov_deg, range_m, ring,
    seq): up to `most` corner mounts a floor that repeat no camera and no mount
    before them."""
    poses = cut(corner_poses(units, cameras))
    poses = poses.join(duplicate_cameras(poses, cameras, SAME_M, SAME_DEG), [*FLOOR, "candidate_id"], "left_anti")
    kept = first_of_kind(cut(seeing(cut(rounded(poses)), walls)))
    order = Window.partitionBy(*FLOOR).orderBy("nth")
    return kept.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= most)


def grid(shapes: DataFrame) -> DataFrame:
    """Points of each floor (floor keys, cell, at), about `GRID_POINTS` of them
    unless the pitch would leave its limits."""
    low, high = GRID_M
    pitch = g.clamp(F.sqrt(F.sum(g.polygon_area(F.col("polygon"))) / GRID_POINTS), low, high)
    return grid_cells(shapes, pitch).select(*FLOOR, "cell", "at")


def inside(points: DataFrame, rings: DataFrame, ring: str = "ring") -> DataFrame:
    """Pairs of points and same-floor rings that hold them. Points of one line (a row
    of a grid) meet a ring together, which is cut by their line once; a tile's
    line has few points, as they lie apart."""
    at, y, box = F.col("at"), F.col("line"), F.col("box")
    held = F.struct(*[c for c in points.columns if c not in FLOOR])
    tiles = [F.floor(at[v] / ROW_TILE_M).cast("int").alias(f"t{v}") for v in "xy"]
    lines = points.select(*FLOOR, *tiles, at["y"].alias("line"), held.alias("held")).groupBy(*FLOOR, "tx", "ty", "line").agg(F.collect_list("held").alias("row"))
    shapes = rings.withColumns({"edges": g.ring_edges(F.col(ring)), "box": g.bbox(F.col(ring))}).drop(ring)
    a, b, keys = split_hot(lines, box_tiles(shapes, "box", ROW_TILE_M).drop("tx0", "ty0"), [*FLOOR, "tx", "ty"], "line")
    pairs = a.join(b.hint("merge"), keys).where((y >= box["y0"]) & (y <= box["y1"]))
    crossing = F.filter("edges", lambda e: (e["ay"] > y) != (e["by"] > y))
    cuts = F.transform(crossing, lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    holds = lambda p: (p["at"]["x"] >= box["x0"]) & (p["at"]["x"] <= box["x1"]) & (F.size(F.filter("cuts", lambda c: p["at"]["x"] < c)) % 2 == 1)
    found = once(pairs, cuts=cuts).withColumn("row", F.filter("row", holds))
    return found.select(*FLOOR, *[c for c in shapes.columns if c not in (*FLOOR, "edges", "box")], F.inline("row"))


def seeds_of(key, points):
    """The next `AHEAD` seeds of one floor's unseen points (one row each, cells in
    order), each the point with most unseen ones within `DENSE_M`, as if all
    before it were given up; with the number and mean of those within `AIM_M`."""
    order = np.argsort(points["cell"].to_numpy())
    cell, x, y = (points[c].to_numpy()[order] for c in ("cell", "x", "y"))
    by_x = np.argsort(x, kind="stable")
    sx = x[by_x]

    def near(i: int, far: float) -> np.ndarray:
        some = by_x[np.searchsorted(sx, x[i] - far - 1e-6) : np.searchsorted(sx, x[i] + far + 1e-6, side="right")]
        return some[np.sqrt((x[some] - x[i]) ** 2 + (y[some] - y[i]) ** 2) <= far]

    count = np.array([len(near(i, DENSE_M)) for i in range(len(x))])
    live = np.ones(len(x), bool)
    rows = []
    for step in range(AHEAD):
        i = int(np.argmax(np.where(live, count, -1)))
        if not live[i] or count[i] < 2:
            break
        aim = near(i, AIM_M)
        aim = aim[live[aim]]
        rows.append((step, cell[i], x[i], y[i], len(aim), x[aim].sum() / len(aim), y[aim].sum() / len(aim)))
        live[i] = False
        count[near(i, DENSE_M)] -= 1
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 2, pa.int64(), *[pa.float64()] * 2]
    names = ["step", "cell", "x", "y", "near", "mx", "my"]
    keys = [pa.array([k.as_py()] * len(rows), t) for k, t in zip(key, (pa.int64(), pa.int32()), strict=True)]
    return pa.table([*keys, *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], [*FLOOR, *names])


SEED = "building_id long, ordinal int, step int, cell long, x double, y double, near long, mx double, my double"


def fill_poses(seeds: DataFrame, shapes: DataFrame, units: DataFrame, placed: DataFrame) -> DataFrame:
    """Poses to try around each seed (floor keys, step, near, candidate_id, nth,
    zone, pose): inside the region, aimed at the mean of what is unseen and to
    either side of it, repeating no camera."""
    spots = F.array(*(F.struct(F.lit(i).alias("spot"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(OFFSETS)))
    at = seeds.select(*FLOOR, "step", "near", "x", "y", "mx", "my", F.inline(spots)).select(
        *FLOOR, "step", "near", "spot", "mx", "my", g.pt(F.col("x") + F.col("dx"), F.col("y") + F.col("dy")).alias("at"),
        F.concat("step", F.lit("/"), "spot").alias("spot_id"),
    )
    within = inside(at.select(*FLOOR, "spot_id", "at"), shapes.select(*FLOOR, F.col("polygon").alias("ring"))).select(*FLOOR, "spot_id").distinct()
    rooms = inside(at.select(*FLOOR, "spot_id", "at"), units.select(*FLOOR, "pos", F.col("name").alias("zone"), F.col("polygon").alias("ring")))
    rooms = rooms.groupBy(*FLOOR, "spot_id").agg(F.min_by("zone", "pos").alias("zone"))
    at = at.join(within, [*FLOOR, "spot_id"], "left_semi").join(rooms, [*FLOOR, "spot_id"], "left")
    dx, dy = F.col("mx") - F.col("at.x"), F.col("my") - F.col("at.y")
    base = F.when((F.col("near") > 1) & (g.hypot(dx, dy) > 0.5), F.degrees(F.atan2(dy, dx))).otherwise(F.lit(0.0))
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(t).alias("by")) for i, t in enumerate(TURNS)))
    poses = at.withColumn("base", base).select("*", F.inline(turns)).select(
        *FLOOR, "step", "near", F.concat("spot_id", F.lit("/"), "turn").alias("candidate_id"), (F.col("spot") * len(TURNS) + F.col("turn")).cast("long").alias("nth"),
        F.coalesce("zone", F.lit("Open floor")).alias("zone"), "at", (F.col("base") + F.col("by")).alias("heading"),
        F.lit(FILL_FOV).alias("fov_deg"), F.lit(FILL_RANGE_M).alias("range_m"),
    )
    return poses.join(duplicate_cameras(poses, placed, SAME_M, SAME_DEG), [*FLOOR, "candidate_id"], "left_anti")


def suggest(units: DataFrame, footprints: DataFrame, cameras: DataFrame, walls: DataFrame, visible: DataFrame, target_pct: float, most: int) -> DataFrame:
    """(floor keys, seq, way, name, at, heading, fov_deg, range_m, gain, ring):
    cameras to add on each floor until `target_pct` of its points are seen, `most`
    a floor. `visible` are the rings of `cameras`; `gain` is the number of points
    that a filling camera recovers."""
    target = min(0.99, max(0.1, target_pct / 100))
    shapes = cut(region(units, footprints))
    walls = cut(walls)
    corners = cut(corner_mounts(units, cameras, walls, most).select(*FLOOR, "seq", "zone", "at", "heading", "fov_deg", "range_m", "ring"))
    taken = corners.groupBy(*FLOOR).agg(F.count("*").alias("corners"))
    # Floors whose corner mounts are all that may be added are not filled.
    cells = cut(grid(shapes.join(taken.where(F.col("corners") >= most), FLOOR, "left_anti")))
    open_floors = cells.select(*FLOOR).distinct()
    sees = visible.where(F.size("ring") >= 3).select(*FLOOR, "ring").unionByName(corners.select(*FLOOR, "ring"))
    seen = inside(cells, sees.join(open_floors, FLOOR, "left_semi"))
    points = cut(cells.join(seen.select(*FLOOR, "cell").distinct().withColumn("seen", F.lit(True)), [*FLOOR, "cell"], "left").select(*FLOOR, "cell", "at", F.coalesce("seen", F.lit(False)).alias("seen"), F.lit(False).alias("dead")))
    floors = points.select(*FLOOR).distinct().join(taken, FLOOR, "left").select(*FLOOR, (F.lit(most) - F.coalesce("corners", F.lit(0))).alias("room"))
    floors = stored(floors.select("*", F.lit(0).cast("long").alias("fills"), F.lit(0).cast("long").alias("steps"), F.lit(FIRST).alias("ahead"), F.lit(False).alias("done")), "floors")
    placed = stored(cameras.select(*FLOOR, "at", "heading").unionByName(corners.select(*FLOOR, "at", "heading")), "placed")
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = []
    # What a round leaves is written and read back: a checkpoint would keep what the
    # optimizer knows of its plan, which grows from round to round until planning does not end.
    while True:
        state = points.groupBy(*FLOOR).agg(F.count_if("seen").alias("met"), F.count("*").alias("all"))
        going = stored(
            floors.join(state, FLOOR).where(~F.col("done") & (F.col("fills") < F.col("room")) & (F.col("steps") < F.col("room") * 5 + 40) & (F.col("met") / F.col("all") < target))
            .select(*FLOOR, "ahead", (F.col("room") * 5 + 40 - F.col("steps")).alias("left")),
            "going",
        )
        if going.isEmpty():
            break
        # A floor that is done never goes again, so its points are left behind.
        mine = points.join(going.select(*FLOOR), FLOOR, "left_semi")
        under = mine.where("not seen and not dead").join(going, FLOOR)
        seeds = stored(
            under.select(*FLOOR, "cell", F.col("at.x").alias("x"), F.col("at.y").alias("y")).groupBy(*FLOOR).applyInArrow(seeds_of, SEED)
            .join(going, FLOOR).where("step < left and step < ahead").drop("left", "ahead"),
            "seeds",
        )
        rings = cut(seeing(cut(rounded(fill_poses(seeds, shapes, units, placed))), walls))
        given_up = seeds.select(*FLOOR, "cell", F.col("step").alias("over"))
        hits = inside(under.select(*FLOOR, "cell", "at").join(given_up, [*FLOOR, "cell"], "left"), rings.select(*FLOOR, "step", "candidate_id", "ring"))
        gains = hits.where("over is null or over >= step").groupBy(*FLOOR, "candidate_id").agg(F.count("*").alias("gain"))
        best = rings.join(gains, [*FLOOR, "candidate_id"]).groupBy(*FLOOR, "step").agg(
            F.max_by(F.struct("near", "gain", "zone", "at", "heading", "fov_deg", "range_m", "ring"), F.struct("gain", -F.col("nth"))).alias("p")
        )
        enough = F.col("p.gain") >= F.greatest(F.lit(LEAST_GAIN), F.floor(F.col("p.near") * GAIN_SHARE))
        won = best.where(enough).groupBy(*FLOOR).agg(F.min_by("p", "step").alias("p"), F.min("step").alias("won")).select(*FLOOR, "won", "p.*")
        nth = (F.lit(most) - F.col("room") + F.col("fills") + 1).cast("int")
        won = stored(won.join(floors.select(*FLOOR, nth.alias("seq")), FLOOR), "won")
        filled.append(won)
        tried = seeds.groupBy(*FLOOR).agg(F.count("*").alias("tried")).join(won.select(*FLOOR, "won"), FLOOR, "left")
        moved = floors.join(going.select(*FLOOR, F.col("left").alias("goes")), FLOOR, "left").join(tried, FLOOR, "left")
        looked = F.coalesce("tried", F.lit(0))
        floors = stored(moved.select(
            *FLOOR, "room", (F.col("fills") + F.when(F.col("won").isNotNull(), 1).otherwise(0)).alias("fills"),
            (F.col("steps") + F.coalesce(F.col("won") + 1, looked)).alias("steps"),
            F.when(F.col("won").isNotNull(), FIRST).otherwise(F.least(F.col("ahead") * 2, F.lit(AHEAD))).alias("ahead"),
            (F.col("done") | (F.col("goes").isNotNull() & F.col("won").isNull() & (looked < F.col("ahead")))).alias("done"),
        ), "floors")
        lost = seeds.join(won.select(*FLOOR, "won"), FLOOR, "left").where("won is null or step < won").select(*FLOOR, "cell", F.lit(True).alias("lost"))
        met = inside(mine.where("not seen").select(*FLOOR, "cell", "at"), won.select(*FLOOR, "ring")).select(*FLOOR, "cell", F.lit(True).alias("met"))
        points = stored(
            mine.join(lost, [*FLOOR, "cell"], "left").join(met, [*FLOOR, "cell"], "left")
            .select(*FLOOR, "cell", "at", (F.col("seen") | F.coalesce("met", F.lit(False))).alias("seen"), (F.col("dead") | F.coalesce("lost", F.lit(False))).alias("dead")),
            "points",
        )
        placed = stored(placed.unionByName(won.select(*FLOOR, "at", "heading")).coalesce(tasks), "placed")
    pose = ["zone", "at", "heading", "fov_deg", "range_m", "ring"]
    out = corners.select(*FLOOR, "seq", F.lit("corner").alias("way"), *pose, F.lit(None).cast("long").alias("gain"))
    for won in filled:
        out = out.unionByName(won.select(*FLOOR, "seq", F.lit("fill").alias("way"), *pose, "gain"))
    name = F.concat("zone", F.lit(" · New "), F.lpad(F.col("seq").cast("string"), F.greatest(F.lit(2), F.length(F.col("seq").cast("string"))), F.lit("0")))
    return out.select(*FLOOR, "seq", "way", name.alias("name"), "at", "heading", "fov_deg", "range_m", "gain", "ring")


def gain(units: DataFrame, footprints: DataFrame, visible: DataFrame, suggested: DataFrame) -> DataFrame:
    """(floor keys, before_pct, after_pct, corner_count, fill_count): the covered
    share of each floor as the coverage layer has it, without and with the
    suggested cameras."""
    now = visible.select(*FLOOR, "camera_id", "ring")
    then = now.unionByName(suggested.select(*FLOOR, F.concat(F.lit("new-"), "seq").alias("camera_id"), "ring"))
    share = lambda rings, name: coverage(units, footprints, rings).select(*FLOOR, F.col("coverage_pct").alias(name))
    counts = suggested.groupBy(*FLOOR).agg(F.count_if(F.col("way") == "corner").alias("corner_count"), F.count_if(F.col("way") == "fill").alias("fill_count"))
    return share(now, "before_pct").join(share(then, "after_pct"), FLOOR).join(counts, FLOOR, "left").fillna(0, ["corner_count", "fill_count"])
