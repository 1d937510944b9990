"""Plans and pair tests that must hold up on large tables."""

import random

from helpers import cameras, footprints, rect, units
from pyspark.sql import functions as F

from floorlens.functions import geometry as g, sight
from floorlens.operators import coverage as cov, probe, quality
from floorlens.operators.walls import walls
from floorlens.plans import routes, suggest


def _blob(rnd, cx, cy, n):
    """A star ring of n corners with eighths of a metre, so that points meet its edges."""
    import math

    out = []
    for i in range(n):
        r = rnd.uniform(1, 6)
        out.append((round((cx + r * math.cos(2 * math.pi * i / n)) * 8) / 8, round((cy + r * math.sin(2 * math.pi * i / n)) * 8) / 8))
    return out


def test_pair_tests_equal_the_expressions(spark):
    rnd = random.Random(3)
    rows = [(i, (rnd.randint(0, 80) / 8, rnd.randint(0, 80) / 8), _blob(rnd, 5, 5, rnd.randint(3, 40)), _blob(rnd, rnd.uniform(-4, 12), 5, rnd.randint(3, 9))) for i in range(600)]
    rows += [(600, (5.0, 5.0), [], []), (601, (5.0, 5.0), rows[0][2], [(0.0, 0.0)]), (602, (1.0, 1.0), [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)])]
    df = spark.createDataFrame(rows, f"id int, at {g.POINT}, a {g.RING}, b {g.RING}")
    at, a, b = F.col("at"), F.col("a"), F.col("b")
    got = df.select(
        "id", sight.ring_holds(at, a).alias("h1"), g.point_in_ring(at, a).alias("h2"), sight.ring_depth(at, a).alias("d1"),
        F.when(g.point_in_ring(at, a), g.ring_min_edge_dist(at, a)).alias("d2"), sight.rings_overlap(a, b).alias("o1"), g.rings_overlap(a, b).alias("o2"),
    ).collect()
    assert len(got) == 603 and 100 < sum(r["h1"] for r in got) < 600 and 50 < sum(r["o1"] for r in got) < 600
    assert [r["id"] for r in got if (r["h1"], r["d1"], r["o1"]) != (r["h2"], r["d2"], r["o2"])] == []


def test_rings_of_poses_are_cast_once(spark):
    """What is asked of a ring reads the ring, where it would else stand for its whole expression, rays included."""
    walls_ = walls(units(spark, [("a", "room", rect(0, 0, 10, 10))]), footprints(spark, [rect(0, 0, 10, 10)]), None)
    pose = cameras(spark, [{"id": "p", "at": (5, 5), "fov": 100}, {"id": "q", "at": (9.95, 5), "fov": 20, "range": 2}])
    poses = pose.withColumnsRenamed({"camera_id": "candidate_id"}).select("building_id", "ordinal", "candidate_id", "at", "heading", "fov_deg", "range_m")
    seen = suggest.seeing(poses, walls_)
    assert [(r["candidate_id"], len(r["ring"]) > 3) for r in seen.collect()] == [("p", True)]
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("_hits(") == 1


def test_lines_of_points_in_rings(spark):
    """Points that meet rings line by line lie where each lies by itself."""
    rnd = random.Random(7)
    points = [(1, 0, i, (i % 40 / 2, i // 40 / 2)) for i in range(1600)] + [(1, 0, 2000 + i, (rnd.uniform(0, 20), rnd.uniform(0, 20))) for i in range(200)] + [(1, 1, 1, (5.0, 5.0)), (1, 0, 9999, None)]
    rings = [(1, 0, i, _blob(rnd, rnd.uniform(-2, 75), rnd.uniform(-2, 20), rnd.randint(3, 30))) for i in range(60)] + [(1, 0, 99, []), (1, 0, 100, [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)])]
    p = spark.createDataFrame(points, f"building_id bigint, ordinal int, cell long, at {g.POINT}")
    r = spark.createDataFrame(rings, f"building_id bigint, ordinal int, ring_id int, ring {g.RING}")
    got = suggest.inside(p, r).select("cell", "ring_id").collect()
    want = p.join(r, ["building_id", "ordinal"]).where(g.point_in_ring(F.col("at"), F.col("ring"))).select("cell", "ring_id").collect()
    assert len(want) > 2000 and sorted(got) == sorted(want)


def test_legs_meet_walls_once(spark):
    """A leg's length and hit are columns; in one filter they are more code than the JVM compiles."""
    runs = spark.createDataFrame([(1, 0, 5, 1, [(0, 1.0, 1.0), (1, 5.0, 1.0), (2, 9.0, 1.0), (3, 9.0, 9.0), (4, 5.0, 9.0)])], "building_id bigint, ordinal int, request_id bigint, run int, pts array<struct<i: int, x: double, y: double>>")
    segs = walls(units(spark, [("a", "room", rect(3, 3, 7, 7))]), footprints(spark, [rect(0, 0, 10, 10)]), None)
    kept = routes.los_shortcut(runs, segs, ["request_id", "building_id", "run"])
    assert [[p["i"] for p in r["kept"]] for r in kept.collect()] == [[0, 2, 3, 4]]
    assert kept._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1


def test_slices_do_not_change_pair_tests(spark, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(5)
    rings = [_blob(rnd, 5, 5, rnd.randint(3, 30)) for _ in range(200)]
    x, y = (pa.array([[p[k] for p in r] for r in rings]) for k in (0, 1))
    px, py = (pa.array([rnd.uniform(0, 10) for _ in rings]) for _ in "xy")
    bx, by = x.take(pa.array(range(199, -1, -1))), y.take(pa.array(range(199, -1, -1)))
    whole = [f.to_pylist() for f in (sight.depths(px, py, x, y), sight.held(px, py, x, y), sight.overlaps(x, y, bx, by))]
    monkeypatch.setattr(sight, "SLICE", 50)
    assert whole == [f.to_pylist() for f in (sight.depths(px, py, x, y), sight.held(px, py, x, y), sight.overlaps(x, y, bx, by))]


def _no_broadcast_of_cells(df):
    """What is broadcast may count exploded rows, but not be such rows."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    for n, line in enumerate(plan):
        at = line.find("BroadcastExchange")
        for x in plan[n + 1 :] if at >= 0 else []:
            if len(x) - len(x.lstrip(" :+-")) <= at or "Aggregate" in x:
                break
            assert "Generate" not in x, line


def test_grids_are_not_broadcast(spark, tmp_path):
    """Stored plans are small files whose cells are many rows."""
    u = units(spark, [("a", "room", rect(0, 0, 9, 9)), ("h", "corridor", rect(0, 9, 20, 12))])
    u.write.parquet(f"{tmp_path}/u")
    footprints(spark, [rect(0, 0, 20, 12)]).write.parquet(f"{tmp_path}/f")
    u, f = spark.read.parquet(f"{tmp_path}/u"), spark.read.parquet(f"{tmp_path}/f")
    rings = u.select("building_id", "ordinal", F.col("unit_id").alias("camera_id"), F.col("polygon").alias("ring"))
    for df in (cov.grid_coverage(u, f, rings), quality.program_gates(u, f)):
        _no_broadcast_of_cells(df)


def test_spans_shuffle_once(spark, tmp_path):
    """Intervals come of each ring by itself; only their ends meet by line."""
    units(spark, [("a", "room", rect(0, 0, 9, 9))]).write.parquet(f"{tmp_path}/u")
    footprints(spark, [rect(0, 0, 20, 12)]).write.parquet(f"{tmp_path}/f")
    u, f = spark.read.parquet(f"{tmp_path}/u"), spark.read.parquet(f"{tmp_path}/f")
    shapes = [_blob(random.Random(i), 8, 6, 5 + i) for i in range(9)] + [rect(2.0, 2.0, 15.0, 150.0)]
    rings = spark.createDataFrame([(1, 0, f"c{i}", r) for i, r in enumerate(shapes)], f"building_id bigint, ordinal int, camera_id string, ring {g.RING}")
    got = cov.spans(u, f, rings, 0.25)
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Exchange hashpartitioning" in x and "line" in x for x in plan) == 1
    rows = got.collect()
    for r in rows:
        x, y = (r.x1 + r.x2) / 2, (r.line + 0.5) * 0.25
        held = sum(sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(s, s[1:] + s[:1], strict=True)) % 2 for s in shapes)
        assert r.cameras == held and r.x2 > r.x1
    assert abs(sum(r.x2 - r.x1 for r in rows) - 48 * 20) < 1e-9 and len({r.cameras for r in rows}) > 3
