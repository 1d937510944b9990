import pytest
from pyspark.sql import functions as F

from floorlens.operators import places, quality, visitor
from floorlens.operators.walls import walls
from floorlens.plans import directions, navgraph, patrol, routes
from helpers import footprints, openings, rect, structures, units, verticals

HALL = [
    ("a", "room", rect(0, 0, 10, 10), "A"), ("b", "room", rect(20, 0, 30, 10), "B"), ("hall", "corridor", rect(0, 10, 30, 14), "Hall"),
]
DOORS = [("da", "a", (5, 10), None), ("db", "b", (25, 10), None)]
NO_LIFT = [("x", "x", "x")]


def req(spark, *pairs):
    return spark.createDataFrame([(i, 1, a, b) for i, (a, b) in enumerate(pairs)], "request_id bigint, building_id bigint, start_id string, goal_id string")


def levels(spark, n=1):
    return spark.createDataFrame([(1, o, f"L{o}", None) for o in range(n)], "building_id bigint, ordinal int, name string, ceiling_m double")


def none(spark):
    return verticals(spark, NO_LIFT).where("false")


def test_route_and_directions(spark):
    u, o = units(spark, HALL), openings(spark, DOORS)
    found = routes.routes(req(spark, ("a", "b"), ("a", "a"), ("a", "ghost")), u, o, none(spark)).orderBy("request_id").collect()
    assert found[0].path == ["a", "door:da", "hall", "door:db", "b"]
    assert found[0].cost == pytest.approx(10 + 2 * (5 + (10**2 + 2**2) ** 0.5) - 10)
    assert (found[1].path, found[1].cost) == (["a"], 0) and found[2].path is None
    r = routes.routes(req(spark, ("a", "b")), u, o, none(spark))
    text = [x.text for x in directions.route_steps(r, u, o, none(spark), levels(spark)).orderBy("step").collect()]
    assert text[0] == "Start at A" and text[1] == "Exit A through the door and turn right"
    assert text[2] == "Follow Hall for ~20 m" and text[3] == "Go through the door into B" and text[-1] == "Arrive at B"
    w = walls(u, footprints(spark, [rect(0, 0, 30, 14)]), structures(spark, [(rect(90, 90, 91, 91), None)]))
    gm = routes.route_geometry(r, u, o, none(spark), w)
    t = gm["totals"].first()
    assert t.metres == pytest.approx(10 + 2 * 104**0.5) and t.floors == [0] and t.eta_min == 1
    assert {p.kind for p in gm["points"].collect()} == {"start", "end"}


def test_requests_share_the_relaxation_of_their_halls(spark, monkeypatch):
    """Paths are relaxed per hall where requests set out, whatever their number."""
    u, o, v = two_floors(spark)
    asked = [("a", "c"), ("a", "h1"), ("h0", "c"), ("a", "e1"), ("e0", "a"), ("h0", "h1"), ("a", "a"), ("c", "h1"), ("e0", "e1")] * 3
    started, relax = [], routes._relax
    monkeypatch.setattr(routes, "_relax", lambda starts, graph: started.extend(starts.collect()) or relax(starts, graph))
    found = {r.request_id: (r.cost, r.path) for r in routes.routes(req(spark, *asked), u, o, v).collect()}
    assert len(started) <= 5 and len(found) == 27
    assert found[0][1] == ["a", "door:d1", "h0", "door:d2", "e0", "e1", "door:d4", "h1", "door:d3", "c"]
    assert found[5][1] == found[0][1][2:-2] and found[1][1] == found[0][1][:-2] and found[8][1] == ["e0", "e1"] and found[6] == (0, ["a"])
    assert found[0][0] == pytest.approx(found[5][0] + found[7][0] * 2) and all(found[i] == found[i % 9] for i in found)


def test_shortcut_only_where_nothing_blocks(spark):
    u, o = units(spark, HALL), openings(spark, DOORS)
    r = routes.routes(req(spark, ("a", "b")), u, o, none(spark))
    post = structures(spark, [(rect(14, 9.5, 16, 10.5), None)])
    open_way = routes.route_geometry(r, u, o, none(spark), walls(u.where("false"), footprints(spark, [rect(-50, -50, 80, 80)]), post.where("false")))
    blocked = routes.route_geometry(r, u, o, none(spark), walls(u.where("false"), footprints(spark, [rect(-50, -50, 80, 80)]), structures(spark, [(rect(14, 4, 16, 10.5), None)])))
    assert open_way["totals"].first().metres == pytest.approx(20)
    assert blocked["totals"].first().metres > 20.1


def two_floors(spark, cat="elevator", name="Elevator"):
    u = units(spark, [
        ("a", "room", rect(0, 0, 10, 10)), ("h0", "corridor", rect(0, 10, 30, 14)), ("e0", cat, rect(20, 0, 30, 10)),
        ("c", "room", rect(0, 0, 10, 10), "C", None, 1), ("h1", "corridor", rect(0, 10, 30, 14), "H", None, 1), ("e1", cat, rect(20, 0, 30, 10), "E", None, 1),
    ])
    o = openings(spark, [("d1", "a", (5, 10), None), ("d2", "e0", (25, 10), None), ("d3", "c", (5, 10), None), ("d4", "e1", (25, 10), None), ("x", "a", (0, 5), "entrance")])
    return u, o, verticals(spark, [("e0", "e1", name)])


@pytest.mark.parametrize("cat,name,ok", [
    ("elevator", "Elevator", True), ("elevator", "Upstairs Elevator", True), ("stairs", "Lift", False),
    ("elevator", "Main Stairs", False), ("elevator", "Escalator 2", False),
])
def test_step_free(spark, cat, name, ok):
    u, o, v = two_floors(spark, cat, name)
    got = routes.routes(req(spark, ("a", "c")), u, o, v, step_free=True).first()
    assert (got.path is not None) == ok
    assert routes.routes(req(spark, ("a", "c")), u, o, v).first().path is not None


def test_errors_and_egress(spark):
    u, o, v = two_floors(spark)
    yard = units(spark, [("yard", "outside", rect(-10, 0, -2, 10))])
    e = routes.egress(req(spark, ("c", "a")), u.unionByName(yard), o, v).first()
    assert e.goal_id == "entrance:x" and e.exit_name == "a" and e.path[-1] == "entrance:x"
    no_hall = u.where("unit_id != 'h1'")
    assert routes.routes(req(spark, ("a", "a")), no_hall, o, v).first().path is None
    assert navgraph.nav_graph(no_hall, o, v)["errors"].count() == 1


def test_review_and_adjacency(spark):
    u = units(spark, [
        ("a", "room", rect(0, 0, 10, 10), "A"), ("b", "room", rect(10, 0, 20, 10), " "), ("hall", "corridor", rect(0, 10, 20, 14), "Hall"),
    ])
    o = openings(spark, [("party", "a", (10, 5), None), ("up", "b", (15, 10), None), ("out", "a", (5, 0), None)])
    adj = {r.opening_id: r.other for r in places.door_adjacency(o, u).collect()}
    assert adj == {"party": "b", "up": "hall", "out": None}
    occ = spark.createDataFrame([(1, "o1", 0, "a", "Shop", "retail", None, None, None, None)],
        "building_id bigint, occupant_id string, pos int, unit_id string, name string, category string, hours string, phone string, website string, anchor struct<x:double,y:double>")
    bad = verticals(spark, [("a", "ghost", "Lift"), ("a", "b", "Flat")])
    rules = sorted(r.rule for r in quality.review(u, o, bad, occ).collect())
    assert rules == ["dangling-vertical", "flat-vertical", "one-sided-door", "unnamed", "vacant"]
    bare = quality.review(u.where("category != 'corridor'"), o.where("false"), bad.where("false"), occ.where("false"))
    assert sorted(r.rule for r in bare.collect()) == ["doorless-floor", "unnamed"]
    lost = quality.review(u.where("category != 'corridor'"), o, bad.where("false"), occ.where("false"))
    assert [r.severity for r in quality.by_severity(lost).collect()][0] == "error"


def test_visitor_cut_hides_the_vault(spark):
    u = units(spark, [("vault", "room", rect(0, 0, 4, 4), "V", "restricted"), ("pub", "room", rect(4, 0, 10, 4), "P"), ("sec", "office", rect(10, 0, 14, 4), "S", "secure")])
    o = openings(spark, [("dv", "vault", (2, 4), None), ("dp", "pub", (6, 4), None)])
    st = structures(spark, [(rect(1, 1, 2, 2), None), (rect(3.5, 1, 5, 2), None), (rect(4, 1, 5, 2), None)])
    fx = st.select("building_id", "ordinal", F.col("structure_id").alias("fixture_id"), "pos", "kind", "polygon")
    am = spark.createDataFrame([(1, 0, "in", 0, (1.0, 1.0), "atm", None), (1, 0, "out", 1, (6.0, 1.0), "atm", None)],
        "building_id bigint, ordinal int, amenity_id string, pos int, at struct<x:double,y:double>, kind string, name string")
    t = {"units": u, "openings": o, "verticals": verticals(spark, [("vault", "pub", "x")]), "occupants": u.select("building_id", "unit_id"),
         "fixtures": fx, "structures": st, "amenities": am, "buildings": u, "levels": u, "footprints": u}
    out = visitor.visitor_cut(t)
    ids = lambda n, k: sorted(r[k] for r in out[n].collect())
    assert ids("units", "unit_id") == ["pub", "sec"] and out["units"].where("security is not null").count() == 0
    assert ids("openings", "opening_id") == ["dp"] and out["verticals"].count() == 0 and ids("occupants", "unit_id") == ["pub", "sec"]
    assert ids("structures", "structure_id") == ["s2"] == ids("fixtures", "fixture_id") and ids("amenities", "amenity_id") == ["out"]


def test_trajectory_and_tour(spark):
    p = spark.createDataFrame([(1, 0, "p", [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0)])], "building_id bigint, ordinal int, patrol_id string, points array<struct<x:double,y:double>>")
    fixes = [tuple(r.at) for r in patrol.trajectory(p, seconds=30.0).orderBy("fix").collect()]
    assert fixes[0] == (0, 0) and fixes[5] == pytest.approx((6, 0)) and fixes[10] == pytest.approx((6, 6)) and fixes[20] == pytest.approx((0, 0))
    u = units(spark, HALL + [("c", "room", rect(10, 0, 20, 10), "C")])
    o = openings(spark, DOORS + [("dc", "c", (15, 10), None)])
    tour = patrol.auto_patrol(u, o, none(spark), None)["tour"]
    assert [r.unit_id for r in tour.orderBy("stop").collect()] == ["a", "c", "b"]
    nodes = [r.node for r in patrol.tour_points(tour, u, o, none(spark)).orderBy("seq").collect()]
    assert nodes == ["a", "door:da", "hall", "door:dc", "c", "door:dc", "hall", "door:db", "b"]


def test_tour_stop_by_stop(spark):
    """The way floors with any links go, on a floor where the sort is right."""
    u = units(spark, HALL + [("c", "room", rect(10, 0, 20, 10), "C")])
    o = openings(spark, DOORS + [("dc", "c", (15, 10), None)])
    graph = navgraph.nav_graph(u, o, none(spark))
    graph["hops"] = navgraph.hops(graph)
    rooms = u.where("category = 'room'").select("building_id", "ordinal", F.col("unit_id").alias("src"), "pos")
    tour = patrol._looped(rooms, graph)
    assert [r.unit_id for r in tour.orderBy("stop").collect()] == ["a", "c", "b"]
    nodes = [r.node for r in patrol.tour_points(tour, u, o, none(spark)).orderBy("seq").collect()]
    assert nodes == ["a", "door:da", "hall", "door:dc", "c", "door:dc", "hall", "door:db", "b"]
    assert patrol._looped(rooms.where("false"), graph).count() == 0


def test_handoffs_are_a_walk_through_the_fixes(spark):
    """Ties, gaps, repeated rows, null subjects and times; stretches longer
    than a block."""
    import random

    from floorlens.plans import patrol

    rng = random.Random(4)
    fixes, seen = [], []
    for i in range(400):
        fixes.append((rng.choice([1, 1, 1, 2, 3]), rng.choice([None, *range(150)]) if i % 9 == 0 else i // 2, i))
        if rng.random() < 0.85:
            first = i // 30 % 4
            seen += [(i, f"c{c}", rng.choice([0.2, 0.5]), c) for c in range(7) if (c == first or rng.random() < 0.4)]
    fixes += [fixes[5], fixes[5], (None, 3, 7), (4, 1, 1000), (5, 1, None)]
    f = spark.createDataFrame(fixes, "subject bigint, s bigint, probe_id bigint").select("subject", F.timestamp_seconds("s").alias("ts"), "probe_id")
    v = spark.createDataFrame(seen, "probe_id bigint, camera_id string, score double, cam_pos bigint")
    want = []
    for who in {k for k, _, _ in fixes}:
        held = None
        for _, t, i in sorted((x for x in fixes if x[0] == who), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or 0)):
            cams = [c for _, c in sorted((-s, c) for p, c, s, _ in seen if p == i)] if who is not None else []
            now = patrol.keep_or_best(held, cams)
            held = now or held
            want.append((who, i, now))
    key = lambda r: tuple(map(str, r))
    for block in (4096, 3):
        got = patrol.handoffs(f, v, block=block).collect()
        assert sorted(((r.subject, r.probe_id, r.camera_id) for r in got), key=key) == sorted(want, key=key)
    assert patrol.handoffs(f.where("false"), v).collect() == []


def test_placeholder_names_count_on(spark):
    from floorlens.operators import places

    old = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (1, 1, "z")], "building_id bigint, ordinal int, camera_id string")
    new = spark.createDataFrame([(1, 0, 20), (1, 0, 3), (1, 1, 1), (1, 2, 5), (2, 0, 9)], "building_id bigint, ordinal int, pos bigint")
    got = {(r.building_id, r.ordinal, r.pos): r.name for r in places.camera_names(new, old).collect()}
    assert got == {(1, 0, 3): "Camera 3", (1, 0, 20): "Camera 4", (1, 1, 1): "Camera 2", (1, 2, 5): "Camera 1", (2, 0, 9): "Camera 1"}
    tours = new.select("building_id", "ordinal").distinct()
    got = {(r.building_id, r.ordinal): r.name for r in places.patrol_names(tours, old.select("building_id", "ordinal")).collect()}
    assert got == {(1, 0): "Auto patrol 4", (1, 1): "Auto patrol 5", (1, 2): "Auto patrol 6", (2, 0): "Auto patrol 1"}


def test_edits_without_a_time_are_sessions_of_their_own(spark):
    from floorlens.streaming.live import edit_sessions

    rows = [(1, "k", "2024-01-01"), (1, "k", None), (1, "k", None), (1, "k", "2024-01-03"), (1, "j", None), (2, "k", "2024-03-01")]
    log = spark.createDataFrame(rows, "user_id long, edit_key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.user_id, r.edit_key, str(r.started)[:10], r.edits) for r in edit_sessions(log, "30 days").collect())
    assert got == [(1, "j", "None", 1), (1, "k", "2024-01-01", 2), (1, "k", "None", 1), (1, "k", "None", 1), (2, "k", "2024-03-01", 1)]
