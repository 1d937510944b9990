"""Camera suggestions against a planner that goes one step after the other."""

import math

import pytest
from pyspark.sql import functions as F

from floorlens.operators.visibility import visibility
from floorlens.operators.walls import walls as walls_of
from floorlens.plans import suggest
from helpers import cameras, footprints, rect, structures, units


def segments(rings):
    return [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def sight(at, heading, fov, reach, walls):
    """Ring of a level camera: every ray to its nearest wall."""
    h, half = math.radians(heading), math.radians(fov) / 2
    rels = {-half + 2 * half * i / n for n in [math.ceil(2 * half / math.radians(4))] for i in range(n + 1)}
    for wall in walls:
        for x, y in wall:
            rel = (math.atan2(y - at[1], x - at[0]) - h + math.pi) % (2 * math.pi) - math.pi
            rels |= {r for r in (rel - 1e-4, rel, rel + 1e-4) if abs(rel) <= half + 1e-4}
    ring = [at]
    for rel in sorted(rels):
        ux, uy, best = math.cos(h + rel), math.sin(h + rel), reach
        for (ax, ay), (bx, by) in walls:
            ex, ey = bx - ax, by - ay
            den = ux * ey - uy * ex
            if abs(den) >= 1e-12:
                t = ((ax - at[0]) * ey - (ay - at[1]) * ex) / den
                u = ((ax - at[0]) * uy - (ay - at[1]) * ux) / den
                if t >= 0 and -1e-9 <= u <= 1 + 1e-9:
                    best = min(best, t)
        ring.append((at[0] + ux * best, at[1] + uy * best))
    return ring


def holds(ring, p):
    odd = False
    for (ax, ay), (bx, by) in segments([ring]):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def size(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in segments([ring]))) / 2


def js_round(v):
    return math.floor(v + 0.5)


def plan(rooms, footprint, blocks, cams, target, most):
    """(way, at, heading, range, gain) of each camera, in order."""
    walls = segments([r for _, _, r in rooms] + [footprint] + blocks)
    shapes = [footprint]
    pitch = min(4, max(1.25, math.sqrt(size(footprint) / 2500)))
    xs, ys = [p[0] for p in footprint], [p[1] for p in footprint]
    points = []
    for i in range(1000):
        for j in range(1000):
            p = (min(xs) + pitch / 2 + i * pitch, min(ys) + pitch / 2 + j * pitch)
            if p[1] >= max(ys):
                break
            if p[0] < max(xs) and any(holds(s, p) for s in shapes):
                points.append(p)
    rings = [sight(c["at"], c["heading"], c["fov"], c["range"], walls) for c in cams]
    placed = [(c["at"], c["heading"]) for c in cams]
    out = []

    def repeats(at, heading):
        gap = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360)
        return any(math.dist(at, p) <= 1.5 and gap(h, heading) <= 25 for p, h in placed)

    def tried(at, heading, fov, reach):
        at, heading = (js_round(at[0] * 10) / 10, js_round(at[1] * 10) / 10), js_round(heading + 360) % 360
        ring = sight(at, heading, fov, reach, walls)
        return (at, heading, ring) if size(ring) >= 15 else None

    def add(way, found, reach, gain):
        at, heading, ring = found
        rings.append(ring)
        placed.append((at, heading))
        out.append((way, at, heading, reach, gain))

    for _, category, room in rooms:
        if len(out) >= most or category in suggest.SKIPPED or size(room) < 25 or any(holds(room, c["at"]) for c in cams):
            continue
        mx, my = sum(p[0] for p in room) / len(room), sum(p[1] for p in room) / len(room)
        k = 1 + sum(size(room) >= m for m in (120, 400, 1200))
        reach = min(50, max(16, js_round(1.7 * math.sqrt(size(room)))))
        for i in range(min(k, len(room))):
            if len(out) >= most:
                break
            v = room[int(i * (len(room) / min(k, len(room)))) % len(room)]
            d = math.dist(v, (mx, my)) or 1
            at = (v[0] + (mx - v[0]) / d * 1.3, v[1] + (my - v[1]) / d * 1.3)
            heading = math.degrees(math.atan2(my - at[1], mx - at[0]))
            if not repeats(at, heading) and (found := tried(at, heading, 100, reach)):
                add("corner", found, reach, None)
    seen = [any(holds(r, p) for r in rings) for p in points]
    dead, fills, room, steps = set(), 0, most - len(out), 0
    while fills < room and steps < room * 5 + 40:
        steps += 1
        under = [j for j in range(len(points)) if not seen[j] and j not in dead]
        if sum(seen) / len(points) >= target / 100 or not under:
            break
        near = lambda j, far: [m for m in under if math.dist(points[j], points[m]) <= far]
        counts = [len(near(j, 14)) for j in under]
        if max(counts) < 2:
            break
        seed = under[counts.index(max(counts))]
        aim = near(seed, 22)
        mx, my = (sum(points[m][c] for m in aim) / len(aim) for c in (0, 1))
        best = None
        for ox, oy in suggest.OFFSETS:
            at = (points[seed][0] + ox, points[seed][1] + oy)
            if not any(holds(s, at) for s in shapes):
                continue
            base = math.degrees(math.atan2(my - at[1], mx - at[0])) if len(aim) > 1 and math.dist(at, (mx, my)) > 0.5 else 0
            for by in (0, 40, -40):
                if not repeats(at, base + by) and (found := tried(at, base + by, 110, 45)):
                    gain = sum(holds(found[2], points[m]) for m in under)
                    if best is None or gain > best[1]:
                        best = (found, gain)
        if best and best[1] >= max(2, math.floor(len(aim) * 0.15)):
            add("fill", best[0], 45, best[1])
            fills += 1
            seen = [s or holds(best[0][2], p) for s, p in zip(seen, points, strict=True)]
        else:
            dead.add(seed)
    return out


ROOMS = [
    ("hall", "corridor", rect(0, 10, 40, 14)), ("a", "room", rect(0, 0, 11, 10)), ("b", "room", rect(11, 0, 25, 10)), ("c", "stairs", rect(25, 0, 40, 10)),
    ("d", "office", rect(0, 14, 4, 18)), ("e", "room", rect(4, 14, 40, 30)),
]
BLOCKS = [rect(15, 20, 17, 26), rect(26.5, 18, 27.5, 27)]
CAMS = [{"at": (1.4, 1.2), "heading": 45, "fov": 90, "range": 14}, {"at": (20.2, 12.1), "heading": 0, "fov": 60, "range": 9}]


@pytest.mark.parametrize("target,most", [(90, 7), (60, 2)])
def test_suggestions_equal_the_step_by_step_planner(spark, target, most):
    footprint = rect(0, 0, 40, 30)
    u, fp, st = units(spark, ROOMS), footprints(spark, [footprint]), structures(spark, [(b, None) for b in BLOCKS])
    c = cameras(spark, CAMS)
    w = walls_of(u, fp, st)
    rings = visibility(c, w)
    found = suggest.suggest(u, fp, c, w, rings, target, most)
    got = [(r.way, (r.at.x, r.at.y), r.heading, r.range_m, r.gain) for r in found.orderBy("seq").collect()]
    want = plan(ROOMS, footprint, BLOCKS, CAMS, target, most)
    assert got == want and len({w[0] for w in want}) == (2 if most > 2 else 1)
    change = suggest.gain(u, fp, rings, found).first()
    assert change.after_pct > change.before_pct and change.corner_count + change.fill_count == len(want)


def test_mounts_that_repeat_one_another(spark):
    """A chain of near mounts: the first, then the first that does not repeat it."""
    rows = [(1, 0, f"p{i}", i, (i * 1.0, 0.0), 10.0, (i * 1.0, 0.0), 10.0) for i in range(6)]
    poses = spark.createDataFrame(rows, "building_id long, ordinal int, candidate_id string, nth long, at struct<x:double,y:double>, heading double, raw_at struct<x:double,y:double>, raw_heading double")
    assert sorted(r.candidate_id for r in suggest.first_of_kind(poses).collect()) == ["p0", "p2", "p4"]
    turned = poses.withColumn("heading", F.col("nth") * 60.0).withColumn("raw_heading", F.col("heading"))
    assert suggest.first_of_kind(turned).count() == 6


def test_rounds_leave_no_joins_behind(spark):
    """Each round's cameras are finished rows: the returned table joins nothing,
    so that no round keeps a broadcast of all floors on the driver."""
    footprint = rect(0, 0, 40, 30)
    u, fp, c = units(spark, ROOMS), footprints(spark, [footprint]), cameras(spark, CAMS)
    w = walls_of(u, fp, structures(spark, [(b, None) for b in BLOCKS]))
    found = suggest.suggest(u, fp, c, w, visibility(c, w), 90, 7)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("way = 'fill'").count() > 1
