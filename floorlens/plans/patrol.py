"""Patrol tours and walking trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g, labels
from ..operators.spatial import FLOOR, number_rows
from ..session import cut
from .navgraph import hops, nav_graph
from .routes import REQ, route_pairs

WALK_MPS = 1.4


def trajectory(patrols: DataFrame, speed: float = 1.0, seconds: float = 120.0, step_m: float = 1.2) -> DataFrame:
    """Position fixes of a guard walking each path back and forth: one fix per
    `step_m` walked for `seconds`."""
    total = g.path_length(F.col("points"))
    n = F.floor(F.lit(WALK_MPS * speed * seconds) / step_m)
    legs = F.transform(
        "points",
        lambda p, i: F.struct(
            g.path_length(F.slice("points", F.lit(1), i + 1)).alias("s"), p["x"].alias("x"), p["y"].alias("y")
        ),
    )
    d = (
        patrols.where(F.size("points") >= 2).withColumns({"total": total, "legs": legs}).where("total > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint"))))
        .withColumn("walked", F.col("i") * step_m)
    )
    cyc = F.pmod(F.col("walked"), F.col("total") * 2)
    d = d.withColumn("s", F.when(cyc <= F.col("total"), cyc).otherwise(F.col("total") * 2 - cyc))
    b = F.get(F.filter("legs", lambda v, i: (i > 0) & (v["s"] >= F.col("s"))), F.lit(0))
    a = F.element_at(F.filter("legs", lambda v, i: (v["s"] < F.col("s")) | (i == 0)), -1)
    d = d.withColumns({"a": a, "b": F.coalesce(b, F.element_at("legs", -1))})
    ln = F.col("b.s") - F.col("a.s")
    t = F.when(ln > 0, (F.col("s") - F.col("a.s")) / F.when(ln > 0, ln)).otherwise(0.0)
    return d.select(
        *FLOOR, "patrol_id", F.col("i").alias("fix"), (F.col("walked") / (WALK_MPS * speed)).alias("t_s"),
        g.pt(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t, F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t).alias("at"),
    )


def arc_lengths(patrols: DataFrame) -> DataFrame:
    """Running length at every waypoint."""
    w = Window.partitionBy(*FLOOR, "patrol_id").orderBy("i")
    p = patrols.select(*FLOOR, "patrol_id", F.posexplode("points").alias("i", "at"))
    leg = F.coalesce(g.dist(F.col("at"), F.lag("at").over(w)), F.lit(0.0))
    return p.withColumn("leg", leg).withColumn(
        "arc", F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def auto_patrol(units, openings, verticals, patrols) -> dict[str, DataFrame]:
    """Greedy nearest-room tour of each floor by route cost, starting at the
    first routable room; ties go to the earlier room.

    Where every room of a floor hangs on its hall alone, the cost of going from
    room p to room q is w(p) + w(q): whichever room one stands in, the nearest
    unvisited one has the smallest w. The whole tour is then one sort. Floors
    where rooms have other links are toured stop by stop, all of them in one
    job a stop; their legs carry the `path` walked.
    """
    graph = nav_graph(units, openings, verticals)
    bad = graph["errors"].select("building_id").distinct()
    rooms = (
        units.where(labels.is_indoor_space(F.col("category")) & ~labels.is_non_routable(F.col("security")))
        .join(bad, "building_id", "left_anti")
        .select(*FLOOR, F.col("unit_id").alias("src"), "pos")
    )
    h = hops(graph)
    hall = units.where("category = 'corridor'").select("building_id", F.col("unit_id").alias("dst"), F.lit(True).alias("is_hall"))
    busy = h.groupBy("building_id", F.col("src").alias("dst")).agg((F.count("*") > 1).alias("through"))
    links = (
        rooms.join(h, ["building_id", "src"], "left").join(hall, ["building_id", "dst"], "left").join(busy, ["building_id", "dst"], "left")
    )
    other = F.col("dst").isNotNull() & F.col("is_hall").isNull() & F.coalesce("through", F.lit(False))
    simple = links.groupBy(*FLOOR).agg((~F.bool_or(other)).alias("simple")).where("simple").select(*FLOOR)
    hung = (
        links.join(simple, FLOOR, "left_semi").where("is_hall")
        .select(*FLOOR, "src", "pos", "dst", F.round("w", 6).alias("w"), "via")
    )
    start = (
        rooms.join(simple, FLOOR, "left_semi").groupBy(*FLOOR).agg(F.min_by("src", "pos").alias("start"))
    )
    tour = hung.join(start, FLOOR).withColumn("lead", F.when(F.col("src") == F.col("start"), 0).otherwise(1))
    # A start that reaches no hall leaves nothing to visit.
    live = tour.where("lead = 0").select(*FLOOR)
    tour = tour.join(live, FLOOR, "left_semi").withColumn(
        "key", F.col("lead") * 1_000_000_000 + F.floor(F.col("w") * 1000)
    )
    order = number_rows(tour, FLOOR, "key", "stop", bucket=1_000_000, ties=["w", "pos"])
    door = F.get("via", F.lit(0))
    hung_tour = order.select(
        *FLOOR, F.col("src").alias("unit_id"), "stop", door.alias("door"), F.col("dst").alias("hall"),
        F.lit(None).cast("array<string>").alias("path"),
    )
    graph["hops"] = h
    looped = cut(rooms.join(simple, FLOOR, "left_anti"))
    return {"tour": hung_tour.unionByName(_looped(looped, graph)), "looped_floors": looped.select(*FLOOR).distinct()}


def _looped(rooms: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """Tours of floors with any links: each round every floor goes on to its
    nearest unvisited room, until none is in reach."""
    first = rooms.groupBy(*FLOOR).agg(F.min_by("src", "pos").alias("unit_id"))
    blank = F.lit(None).cast("string")
    tour = cut(first.select(
        *FLOOR, "unit_id", F.lit(1).cast("bigint").alias("stop"), blank.alias("door"), blank.alias("hall"),
        F.lit(None).cast("array<string>").alias("path"),
    ))
    if tour.isEmpty():
        return tour
    goals = rooms.select(*FLOOR, F.col("src").alias("goal_id"), "pos")
    pairs = rooms.select(*FLOOR, F.col("src").alias("request_id")).join(goals, FLOOR).where("request_id != goal_id")
    legs = cut(
        route_pairs(pairs.select(*REQ, F.col("request_id").alias("start_id"), "goal_id"), graph)
        .join(goals, ["building_id", "goal_id"])
        .select(*FLOOR, F.col("request_id").alias("unit_id"), "goal_id", "pos", F.round("cost", 6).alias("cost"), "path")
    )
    stop = 1
    while True:
        been = tour.select(*FLOOR, F.col("unit_id").alias("goal_id"))
        step = (
            tour.where(F.col("stop") == stop).select(*FLOOR, "unit_id").join(legs, [*FLOOR, "unit_id"])
            .join(been, [*FLOOR, "goal_id"], "left_anti")
            .groupBy(*FLOOR).agg(F.min(F.struct("cost", "pos", "goal_id", "path")).alias("best"))
        )
        stop += 1
        fresh = cut(step.select(
            *FLOOR, F.col("best.goal_id").alias("unit_id"), F.lit(stop).cast("bigint").alias("stop"),
            blank.alias("door"), blank.alias("hall"), F.col("best.path").alias("path"),
        ))
        if fresh.isEmpty():
            return tour
        tour = cut(tour.unionByName(fresh))


def tour_points(tour: DataFrame, units, openings, verticals) -> DataFrame:
    """Waypoints of a tour in order: room, door, hall, door, room ...; repeats
    of the same point in a row are dropped."""
    nodes = nav_graph(units, openings, verticals)["nodes"].select("building_id", "node", "xy", F.col("ordinal").alias("on"))
    looped = tour.join(tour.where("path is not null").select(*FLOOR).distinct(), FLOOR, "left_semi")
    tour = tour.join(looped.select(*FLOOR).distinct(), FLOOR, "left_anti")
    # A leg starts where the one before it ended, so its first node is left out.
    walked = F.when(F.col("path").isNull(), F.array("unit_id")).otherwise(F.slice("path", F.lit(2), F.size("path")))
    legs = looped.select(*FLOOR, "stop", F.posexplode(walked).alias("i", "node")).select(
        *FLOOR, (F.col("stop") * 1_000_000 + F.col("i")).alias("seq"), "node"
    )
    n = tour.groupBy(*FLOOR).agg(F.max("stop").alias("last")).where("last > 1")
    parts = F.array(
        F.struct(F.lit(0).alias("k"), F.when(F.col("stop") > 1, F.col("hall")).alias("node")),
        F.struct(F.lit(1).alias("k"), F.when(F.col("stop") > 1, F.col("door")).alias("node")),
        F.struct(F.lit(2).alias("k"), F.col("unit_id").alias("node")),
        F.struct(F.lit(3).alias("k"), F.when(F.col("stop") < F.col("last"), F.col("door")).alias("node")),
    )
    rows = tour.join(n, FLOOR).select(*FLOOR, "stop", F.inline(parts)).where("node is not null")
    rows = rows.select(*FLOOR, (F.col("stop") * 4 + F.col("k")).alias("seq"), "node").unionByName(legs)
    return rows.join(nodes, ["building_id", "node"]).where(F.col("on") == F.col("ordinal")).select(
        *FLOOR, "seq", "node", F.col("xy").alias("at")
    )


def keep_or_best(current, cams):
    """The camera to follow next: the current one while it sees the subject,
    else the best (first) one, else none."""
    if current is not None and current in cams:
        return current
    return cams[0] if len(cams) else None


#: Fixes of a subject in one block; stretches of sight are cut at its edges.
BLOCK = 4096


def handoffs(fixes: DataFrame, seen: DataFrame, subject: str = "subject", block: int = BLOCK) -> DataFrame:
    """The camera followed per subject over time, a row per row of
    fixes(subject, ts, probe_id); seen as produced by probe.see. Fixes follow
    each other by ts, then probe_id; one that no camera sees has none, and the
    camera before it goes on if it sees the next. Rows without a subject have
    none either.

    While one camera sees consecutive fixes, these are a stretch, and where it
    ends the fix after it tells which stretch comes next: it depends on no
    earlier choice. So each stretch has one successor, and those that are
    followed are found from the first by pointer doubling; no subject is walked
    through in one task."""
    key = [subject, "camera_id", "first"]
    best = Window.partitionBy("probe_id").orderBy(F.desc("score"), "cam_pos", "camera_id")
    views = seen.select("probe_id", "camera_id", F.row_number().over(best).alias("place"))
    at = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))
    known = fixes.where(F.col(subject).isNotNull()).select(subject, "ts", "probe_id").distinct()
    some = cut(known.join(views.where("place = 1").select("probe_id"), "probe_id").withColumn("at", at))
    order = number_rows(some, [subject], "at", "n", bucket=3_600_000_000, ties=["probe_id"])
    sight = order.join(views, "probe_id").withColumn("block", F.floor(F.col("n") / block))
    along = Window.partitionBy(subject, "camera_id", "block").orderBy("n")
    run = sight.withColumn("run", F.col("n") - F.row_number().over(along))
    whole = Window.partitionBy(subject, "camera_id", "block", "run")
    rows = cut(
        run.withColumn("first", F.min("n").over(whole)).withColumn("last", F.max("n").over(whole))
        .select(subject, "ts", "probe_id", "n", "camera_id", "place", "first", "last")
    )
    stretches = rows.where("n = first").select(*key, (F.col("last") + 1).alias("entry"))
    on = stretches.select(subject, "camera_id", F.col("first").alias("entry"), F.lit(True).alias("on"))
    fresh = rows.where("place = 1").select(subject, F.col("n").alias("entry"), F.col("camera_id").alias("cam"), F.col("first").alias("start"))
    after = F.col("on").isNotNull()
    jumps = cut(
        stretches.join(fresh, [subject, "entry"])
        .join(on, [subject, "camera_id", "entry"], "left")
        .select(
            *key, "entry",
            F.when(after, F.col("camera_id")).otherwise(F.col("cam")).alias("next_camera"),
            F.when(after, F.col("entry")).otherwise(F.col("start")).alias("next_first"),
        )
    )
    followed = cut(rows.where("n = 1 and place = 1").select(*key, F.col("n").alias("entry")))
    reached = followed.count()
    while True:
        steps = followed.select(*key).join(jumps, key).select(
            subject, F.col("next_camera").alias("camera_id"), F.col("next_first").alias("first"), "entry"
        )
        followed = cut(followed.union(steps).distinct())
        before, reached = reached, followed.count()
        if reached == before:
            break
        then = jumps.select(
            subject, F.col("camera_id").alias("next_camera"), F.col("first").alias("next_first"),
            F.col("entry").alias("entry2"), F.col("next_camera").alias("camera2"), F.col("next_first").alias("first2"),
        )
        jumps = cut(
            jumps.join(then, [subject, "next_camera", "next_first"])
            .select(*key, F.col("entry2").alias("entry"), F.col("camera2").alias("next_camera"), F.col("first2").alias("next_first"))
        )
    picked = rows.join(followed, key).where("n >= entry").select(subject, "ts", "probe_id", "camera_id")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (subject, "ts", "probe_id")]
    return fixes.alias("f").join(picked.alias("p"), same, "left").select(*[F.col(f"f.{c}") for c in (subject, "ts", "probe_id")], "camera_id")
