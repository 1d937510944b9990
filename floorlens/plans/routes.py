"""Routes for whole tables of requests at once.

Starts relax together: a round extends every open path by one hop and keeps
the cheapest path per (start, node). Doors are folded into hops and rooms that
lead nowhere are never entered, so a round touches halls and verticals only.
Requests that leave by the same hall share one start; their first and last hops
are equi-joins on (building, room).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g, labels
from ..operators.spatial import FLOOR, box_join, once
from ..operators.walls import distinct_segments
from ..session import cut
from .navgraph import hops, nav_graph

WALK_MPS = 1.4
EPS = 0.05
REQ = ["request_id", "building_id"]


def _through(graph: dict[str, DataFrame]) -> DataFrame:
    """Hops between nodes with more than one neighbour."""
    h = graph["hops"]
    busy = h.groupBy("building_id", "src").count().where("count > 1").select("building_id", F.col("src").alias("dst"))
    return h.join(busy, ["building_id", "dst"], "left_semi")


def _relax(starts: DataFrame, graph) -> DataFrame:
    """Cheapest path from each request's start to every through node. One job
    per round: fresh rows step on, and the minimum per node decides what is
    fresh next. Paths do not repeat nodes, so rounds end by themselves."""
    through = cut(_through(graph))
    state = cut(
        starts.select(
            *REQ, F.col("start_id").alias("node"), F.lit(0.0).alias("cost"),
            F.array("start_id").alias("path"), F.lit(True).alias("fresh"),
        )
    )
    while True:
        step = (
            state.where("fresh")
            .withColumnRenamed("node", "src")
            .join(through, ["building_id", "src"])
            .where(~F.array_contains("path", F.col("dst")))
            .select(
                *REQ, F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"),
                F.concat("path", "via", F.array("dst")).alias("path"), F.lit(True).alias("fresh"),
            )
        )
        order = F.struct(
            F.round("cost", 6).alias("k"), F.concat_ws(">", "path").alias("t"), "fresh", "cost", "path"
        )
        state = cut(
            state.withColumn("fresh", F.lit(False))
            .unionByName(step)
            .groupBy(*REQ, "node")
            .agg(F.min(order).alias("m"))
            .select(*REQ, "node", "m.cost", "m.path", "m.fresh")
        )
        if state.where("fresh").limit(1).count() == 0:
            return state.drop("fresh")


def routes(
    requests: DataFrame, units, openings, verticals, step_free: bool = False
) -> DataFrame:
    """(request_id, building_id, start_id, goal_id, cost, path); cost and path
    are NULL where there is no route or the building's graph is broken."""
    graph = nav_graph(units, openings, verticals, step_free)
    graph["hops"] = hops(graph)
    node = graph["nodes"].where("kind = 'unit'").select("building_id", "node")
    has = lambda c: node.withColumnRenamed("node", c)
    live = (
        requests.join(graph["errors"].select("building_id").distinct(), "building_id", "left_anti")
        .join(has("start_id"), ["building_id", "start_id"], "left_semi")
        .join(has("goal_id"), ["building_id", "goal_id"], "left_semi")
        .select(*REQ, "start_id", "goal_id")
    )
    return requests.select(*REQ, "start_id", "goal_id").join(route_pairs(live, graph).drop("goal_id"), REQ, "left")


def _ends(graph: dict[str, DataFrame], name: str) -> DataFrame:
    """Of each node `{name}_id` with neighbours: the through node where paths
    from it join the others (itself, or else its only neighbour) and, for the
    latter, that hop."""
    end = F.col(f"{name}_id")
    out = graph["hops"].groupBy("building_id", F.col("src").alias(f"{name}_id")).agg(
        F.count("*").alias("n"), F.min(F.struct("dst", "w", "via")).alias("hop")
    )
    alone = F.col("n") == 1
    return out.select(
        "building_id", end, F.when(alone, F.col("hop.dst")).otherwise(end).alias(f"{name}_at"), F.when(alone, F.col("hop")).alias(f"{name}_hop")
    )


def route_pairs(pairs: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """Cheapest path of each (request_id, building_id, start_id, goal_id) that
    has one. A node with one neighbour is entered and left by that hop alone, so
    paths are relaxed once per building and node where requests meet the through
    nodes, and a request adds its first and last hop."""
    pairs = pairs.select(*REQ, "start_id", "goal_id").distinct()
    ends = pairs.where("start_id != goal_id").join(_ends(graph, "start"), ["building_id", "start_id"]).join(_ends(graph, "goal"), ["building_id", "goal_id"])
    ends = cut(ends)
    starts = ends.select(F.col("start_at").alias("request_id"), "building_id", F.col("start_at").alias("start_id")).distinct()
    best = _relax(starts, graph).select(F.col("request_id").alias("start_at"), "building_id", F.col("node").alias("goal_at"), "cost", "path")
    first, last = F.col("start_hop"), F.col("goal_hop")
    near = first.isNotNull() & last.isNotNull() & (first["dst"] == F.col("goal_id"))
    empty = F.array().cast("array<string>")
    head = F.when(first.isNotNull(), F.concat(F.array("start_id"), first["via"])).otherwise(empty)
    tail = F.when(last.isNotNull(), F.concat(last["via"], F.array("goal_id"))).otherwise(empty)
    zero = lambda hop: F.coalesce(hop["w"], F.lit(0.0))
    here = pairs.where("start_id = goal_id").select(*REQ, "goal_id", F.lit(0.0).alias("cost"), F.array("start_id").alias("path"))
    beside = ends.where(near).select(*REQ, "goal_id", first["w"].alias("cost"), F.concat(F.array("start_id"), first["via"], F.array("goal_id")).alias("path"))
    through = ends.where(~near).join(best, ["building_id", "start_at", "goal_at"]).select(
        *REQ, "goal_id", (zero(first) + F.col("cost") + zero(last)).alias("cost"), F.concat(head, "path", tail).alias("path")
    )
    return here.unionByName(beside).unionByName(through)


def egress(
    requests: DataFrame, units, openings, verticals, step_free: bool = False
) -> DataFrame:
    """Cheapest entrance of the building from each start."""
    graph = nav_graph(units, openings, verticals, step_free)
    graph["hops"] = hops(graph)
    node = graph["nodes"].where("kind = 'unit'").select("building_id", F.col("node").alias("start_id"))
    live = (
        requests.join(graph["errors"].select("building_id").distinct(), "building_id", "left_anti")
        .join(node, ["building_id", "start_id"], "left_semi")
        .select(*REQ, "start_id")
    )
    best = _relax(live, graph)
    doors = graph["doors"].where("is_entrance")
    exits = (
        doors.select("building_id", F.col("owner").alias("node"), "door", "opening_pos", F.col("w_owner").alias("w"))
        .unionByName(doors.select("building_id", F.col("hub").alias("node"), "door", "opening_pos", F.col("w_hub").alias("w")))
    )
    # Dead-end owners are not through nodes: reach them by one more hop.
    near = graph["hops"].select("building_id", F.col("src").alias("node"), F.col("dst").alias("owner"), F.col("w").alias("hop"), "via")
    ends = exits.select("building_id", F.col("node").alias("owner"), "door", "opening_pos", "w")
    two = (
        near.join(ends, ["building_id", "owner"])
        .where(~F.array_contains("via", F.col("door")))
        .select("building_id", "node", "door", "opening_pos", (F.col("hop") + F.col("w")).alias("w"),
                F.concat("via", F.array("owner", "door")).alias("tail"))
    )
    tails = exits.select("building_id", "node", "door", "opening_pos", "w", F.array("door").alias("tail")).unionByName(two)
    reach = (
        best.join(tails, ["building_id", "node"])
        .where(~F.arrays_overlap("path", "tail"))
        .select(*REQ, "door", "opening_pos", (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", "tail").alias("path"))
    )
    pick = reach.groupBy(*REQ).agg(
        F.min(F.struct(F.round("cost", 6).alias("k"), "opening_pos", F.concat_ws(">", "path").alias("t"), "cost", "path", "door")).alias("m")
    )
    owner = doors.select("building_id", "door", F.col("owner").alias("unit_id")).join(
        units.select("building_id", "unit_id", F.col("name").alias("exit_name")), ["building_id", "unit_id"]
    ).drop("unit_id")
    return (
        requests.select(*REQ, "start_id")
        .join(pick.select(*REQ, "m.cost", "m.path", "m.door"), REQ, "left")
        .join(owner, ["building_id", "door"], "left")
        .withColumnRenamed("door", "goal_id")
    )


def path_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per step of each path, with node details."""
    return (
        found.where("path is not null")
        .select(*REQ, F.size("path").alias("n"), F.posexplode("path").alias("i", "node"))
        .join(nodes, ["building_id", "node"])
    )


def _runs(steps: DataFrame) -> DataFrame:
    """Maximal same-floor runs of each path, points in order."""
    w = Window.partitionBy(*REQ).orderBy("i")
    turn = F.coalesce(F.col("ordinal") != F.lag("ordinal").over(w), F.lit(True)).cast("int")
    return (
        steps.withColumn("turn", turn)
        .withColumn("run", F.sum("turn").over(w))
        .groupBy(*REQ, "ordinal", "run")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.col("xy.x").alias("x"), F.col("xy.y").alias("y")))).alias("pts"))
    )


def los_shortcut(runs: DataFrame, walls: DataFrame, run_keys: list[str]) -> DataFrame:
    """Drop intermediate points wherever a straight leg meets no wall: from
    each kept point go to the farthest later point in sight. `runs` carries
    `pts`, a short array in walking order; adds `kept`."""
    n = F.size("pts")
    i, j = F.col("i"), F.col("j")
    legs = (
        runs.where(n > 2)
        .select(
            *FLOOR, *[k for k in run_keys if k not in FLOOR], "pts",
            F.explode(F.sequence(F.lit(0), n - 3)).alias("i"),
        )
        .withColumn("j", F.explode(F.sequence(i + 2, F.size("pts") - 1)))
        .withColumns({"p": F.get("pts", i), "q": F.get("pts", j)})
        .drop("pts")
        .withColumn(
            "lbox",
            F.struct(
                F.least("p.x", "q.x").alias("x0"), F.least("p.y", "q.y").alias("y0"),
                F.greatest("p.x", "q.x").alias("x1"), F.greatest("p.y", "q.y").alias("y1"),
            ),
        )
    )
    segs = distinct_segments(walls).select(
        *FLOOR, "a", "b",
        F.struct(
            F.least("a.x", "b.x").alias("x0"), F.least("a.y", "b.y").alias("y0"),
            F.greatest("a.x", "b.x").alias("x1"), F.greatest("a.y", "b.y").alias("y1"),
        ).alias("rbox"),
    )
    # One step after the other: in one expression these are more code than the JVM compiles.
    pairs = once(box_join(legs, segs), dx=F.col("q.x") - F.col("p.x"), dy=F.col("q.y") - F.col("p.y"))
    pairs = once(pairs, ln=g.hypot(F.col("dx"), F.col("dy")))
    ln = F.col("ln")
    safe = F.when(ln >= 1e-9, ln)
    pairs = once(pairs, ux=F.col("dx") / safe, uy=F.col("dy") / safe)
    t = g.ray_segment_t(
        F.col("p.x"), F.col("p.y"), F.col("ux"), F.col("uy"),
        F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"),
    )
    pairs = once(pairs, t=t, end=ln - EPS)
    key = [*dict.fromkeys([*FLOOR, *run_keys])]
    blocked = pairs.where((F.col("t") > EPS) & (F.col("t") < F.col("end"))).select(*key, "i", "j").distinct()
    far = (
        legs.select(*key, "i", "j")
        .join(blocked, [*key, "i", "j"], "left_anti")
        .groupBy(*key, "i").agg(F.max("j").alias("j"))
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("i", "j"))).alias("far"))
    )
    nxt = lambda k: F.coalesce(F.try_element_at("far", k), k + 1)
    chain = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        F.array(F.lit(0)),
        lambda acc, k: F.when(F.element_at(acc, -1) == k, F.concat(acc, F.array(nxt(k)))).otherwise(acc),
    )
    return (
        runs.join(far, key, "left")
        .withColumn("kept", F.when(n <= 2, F.col("pts")).otherwise(F.transform(chain, lambda k: F.get("pts", k))))
        .drop("far")
    )


def route_geometry(found: DataFrame, units, openings, verticals, walls) -> dict[str, DataFrame]:
    """Per-floor lines (shortcut, corners rounded), totals, and marker points."""
    nodes = nav_graph(units, openings, verticals)["nodes"].select("building_id", "node", "ordinal", "xy")
    steps = path_nodes(found, nodes)
    runs = los_shortcut(_runs(steps), walls, [*REQ, "run"])
    xy = F.transform("kept", lambda p: g.pt(p["x"], p["y"]))
    lines = runs.where(F.size("pts") > 1).select(
        *REQ, "run", "ordinal",
        g.path_length(xy).alias("metres"), g.round_corners(xy).alias("line"),
    )
    first = runs.groupBy(*REQ, "ordinal").agg(F.min("run").alias("run"))
    floors = first.groupBy(*REQ).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run", "ordinal"))), lambda s: s["ordinal"]).alias("floors")
    )
    walked = lines.groupBy(*REQ).agg(F.sum("metres").alias("metres"))
    totals = floors.join(walked, REQ, "left").fillna(0.0, ["metres"]).withColumn(
        "eta_min", F.greatest(F.lit(1), F.ceil(F.col("metres") / WALK_MPS / 60)).cast("int")
    )
    w = Window.partitionBy(*REQ).orderBy("i")
    marks = steps.withColumns(
        {"before": F.lag("ordinal").over(w), "after": F.lead("ordinal").over(w)}
    )
    moved = (F.coalesce("before", "ordinal") != F.col("ordinal")) | (F.coalesce("after", "ordinal") != F.col("ordinal"))
    kinds = F.filter(
        F.array(
            F.when(moved, "transition"), F.when(F.col("i") == 0, "start"),
            F.when(F.col("i") == F.col("n") - 1, "end"),
        ),
        lambda k: k.isNotNull(),
    )
    points = marks.select(*REQ, "ordinal", "i", "node", "xy", F.explode(kinds).alias("kind"))
    return {"lines": lines, "totals": totals, "points": points}


def selectable_endpoints(units: DataFrame, occupants: DataFrame) -> DataFrame:
    """Everything a route may start or end at: units, and tenants by unit."""
    ok = units.where(labels.is_selectable(F.col("category"), F.col("security")))
    rooms = ok.select(
        "building_id", F.concat(F.lit("u:"), "unit_id").alias("token"), "unit_id", "name"
    )
    tenants = occupants.select("building_id", "unit_id", "occupant_id", "name").join(
        ok.select("building_id", "unit_id"), ["building_id", "unit_id"], "left_semi"
    )
    return rooms.unionByName(
        tenants.select("building_id", F.concat(F.lit("o:"), "occupant_id").alias("token"), "unit_id", "name")
    )


def default_endpoints(units: DataFrame) -> DataFrame:
    """First and last selectable unit per building."""
    ok = units.where(labels.is_selectable(F.col("category"), F.col("security")))
    return ok.groupBy("building_id").agg(
        F.min_by("unit_id", "pos").alias("start_id"), F.max_by("unit_id", "pos").alias("goal_id")
    )
