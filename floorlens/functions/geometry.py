"""Plane geometry as Column -> Column helpers.

Points are ``struct<x double, y double>``; rings are open ``array<point>``
columns (first point not repeated); all lengths are metres. Everything here is
built from JVM-side expressions, so it fuses with the surrounding plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

M_PER_DEG_LAT = 111320.0
RING = "array<struct<x:double,y:double>>"
POINT = "struct<x:double,y:double>"


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def pt(x, y) -> Column:
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once and named, so that a large
    expression is not repeated through the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypot(dx: Column, dy: Column) -> Column:
    """sqrt(dx^2 + dy^2); written out so that other engines can match it bit for bit."""
    return F.sqrt(dx * dx + dy * dy)


def clamp(v, lo, hi) -> Column:
    return F.least(F.greatest(lit(v), lit(lo)), lit(hi))


def round_half_up(v: Column) -> Column:
    """Round .5 towards +infinity (Spark's own round goes away from zero)."""
    return F.floor(v + F.lit(0.5)).cast("double")


# -- projection ------------------------------------------------------------


def m2ll(lng0: Column, lat0: Column, p: Column) -> Column:
    """Local metres to [lng, lat]."""
    k = F.lit(M_PER_DEG_LAT)
    return F.array(lng0 + p["x"] / (k * F.cos(F.radians(lat0))), lat0 + p["y"] / k)


def ll2m(lng0: Column, lat0: Column, lng: Column, lat: Column) -> Column:
    """[lng, lat] to a local point in metres."""
    k = F.lit(M_PER_DEG_LAT)
    return pt((lng - lng0) * (k * F.cos(F.radians(lat0))), (lat - lat0) * k)


def points_to_ll(lng0: Column, lat0: Column, pts: Column) -> Column:
    return F.transform(pts, lambda p: m2ll(lng0, lat0, p))


def closed(ring: Column) -> Column:
    return F.when(F.size(ring) > 0, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def polygon_ring(lng0: Column, lat0: Column, ring: Column) -> Column:
    """Closed lng/lat ring, ready for a GeoJSON polygon."""
    return points_to_ll(lng0, lat0, closed(ring))


# -- points and segments ---------------------------------------------------


def snap_point(p: Column, size) -> Column:
    s = lit(size)
    safe = F.when(s > 0, s)
    return F.when(
        s > 0,
        pt(round_half_up(p["x"] / safe) * s, round_half_up(p["y"] / safe) * s),
    ).otherwise(p)


def dist(a: Column, b: Column) -> Column:
    return hypot(a["x"] - b["x"], a["y"] - b["y"])


def seg_t(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Clamped position (0..1) along a-b of the point nearest to p."""
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    return F.when(l2 == 0, F.lit(0.0)).otherwise(
        clamp(((px - ax) * dx + (py - ay) * dy) / F.when(l2 != 0, l2), 0.0, 1.0)
    )


def seg_dist(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = seg_t(px, py, ax, ay, bx, by)
    return hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def project_on_segment(p: Column, a: Column, b: Column) -> Column:
    t = seg_t(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"])
    return pt(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))


def ray_segment_t(ox, oy, dx, dy, ax, ay, bx, by) -> Column:
    """Distance along the unit ray (o, d) to segment a-b, or NULL on a miss."""
    ex, ey = bx - ax, by - ay
    den = dx * ey - dy * ex
    safe = F.when(F.abs(den) >= 1e-12, den)
    t = ((ax - ox) * ey - (ay - oy) * ex) / safe
    u = ((ax - ox) * dy - (ay - oy) * dx) / safe
    return F.when((t >= 0) & (u >= 0) & (u <= 1), t)


def wrap_pi(a: Column) -> Column:
    """Angle wrapped into (-pi, pi]."""
    two_pi = F.lit(2 * math.pi)
    return a - two_pi * F.ceil((a - F.lit(math.pi)) / two_pi)


# -- rings -----------------------------------------------------------------


def nth(ring: Column, i: Column) -> Column:
    """Vertex i, wrapping round the ring."""
    n = F.size(ring)
    return F.get(ring, F.pmod(i, F.when(n > 0, n)).cast("int"))


def ring_edges(ring: Column) -> Column:
    """array<struct<i, ax, ay, bx, by>> of the closed outline."""
    return let(
        ring,
        lambda r: F.transform(
            r,
            lambda p, i: F.struct(
                i.alias("i"),
                p["x"].alias("ax"),
                p["y"].alias("ay"),
                nth(r, i + 1)["x"].alias("bx"),
                nth(r, i + 1)["y"].alias("by"),
            ),
        ),
    )


def _sum(arr: Column, f) -> Column:
    return F.aggregate(F.transform(arr, f), F.lit(0.0), lambda acc, v: acc + v)


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def polygon_area(ring: Column) -> Column:
    """Absolute shoelace area; 0 below three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(
        F.abs(_sum(ring_edges(ring), _cross)) / 2
    )


def vertex_mean(ring: Column) -> Column:
    def mean(r):
        n = F.when(F.size(r) > 0, F.size(r).cast("double"))
        return pt(_sum(r, lambda p: p["x"]) / n, _sum(r, lambda p: p["y"]) / n)

    return let(ring, mean)


def polygon_centroid(ring: Column) -> Column:
    """Area-weighted centroid; the vertex mean when the ring has no area."""
    sums = let(
        ring_edges(ring),
        lambda e: F.struct(
            (_sum(e, _cross) * 0.5).alias("a"),
            _sum(e, lambda s: (s["ax"] + s["bx"]) * _cross(s)).alias("sx"),
            _sum(e, lambda s: (s["ay"] + s["by"]) * _cross(s)).alias("sy"),
            F.size(e).alias("n"),
        ),
    )
    flat = lambda s: (F.abs(s["a"]) < 1e-6) | (s["n"] < 3)
    a6 = lambda s: F.when(~flat(s), s["a"] * 6)
    return let(
        sums,
        lambda s: F.when(flat(s), vertex_mean(ring)).otherwise(pt(s["sx"] / a6(s), s["sy"] / a6(s))),
    )


def bbox(ring: Column) -> Column:
    def box(r):
        return F.struct(
            F.array_min(r["x"]).alias("x0"),
            F.array_min(r["y"]).alias("y0"),
            F.array_max(r["x"]).alias("x1"),
            F.array_max(r["y"]).alias("y1"),
        )

    return let(ring, box)


def polygon_perimeter(ring: Column) -> Column:
    return F.when(F.size(ring) < 2, F.lit(0.0)).otherwise(
        _sum(ring_edges(ring), lambda e: hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
    )


def path_length(pts: Column) -> Column:
    """Length of an open polyline."""
    return _sum(
        F.transform(pts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda s: F.when(
            s["i"] > 0, dist(s["p"], F.coalesce(F.get(pts, s["i"] - 1), s["p"]))
        ).otherwise(F.lit(0.0)),
    )


def nearest_on_polygon(p: Column, ring: Column) -> Column:
    """Closest boundary point; the first edge wins ties."""
    cand = F.transform(
        ring_edges(ring),
        lambda e: F.struct(
            seg_dist(p["x"], p["y"], e["ax"], e["ay"], e["bx"], e["by"]).alias("d"),
            e["i"].alias("i"),
            project_on_segment(p, pt(e["ax"], e["ay"]), pt(e["bx"], e["by"])).alias("q"),
        ),
    )
    return F.array_min(cand)["q"]


def rect_poly(x0, y0, x1, y1) -> Column:
    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))


def column_polygon(center: Column, radius: Column, sides: int = 12) -> Column:
    """Regular n-gon, counter-clockwise from angle 0."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(sides - 1)),
        lambda i: pt(
            center["x"] + radius * F.cos(i * F.lit(2 * math.pi / sides)),
            center["y"] + radius * F.sin(i * F.lit(2 * math.pi / sides)),
        ),
    )


def crosses_right(px, py, ax, ay, bx, by) -> Column:
    """True when the +x ray from p crosses edge a-b (half-open in y)."""
    span = F.when(by != ay, by - ay)
    hit = F.coalesce(px < (bx - ax) * (py - ay) / span + ax, F.lit(False))
    return ((ay > py) != (by > py)) & hit


def edges_contain(px, py, edges: Column) -> Column:
    """Even-odd test against a prepared edge array."""
    def odd(p):
        n = F.size(
            F.filter(
                edges, lambda e: crosses_right(p["x"], p["y"], e["ax"], e["ay"], e["bx"], e["by"])
            )
        )
        return (n % 2) == 1

    return let(pt(px, py), odd)


def edges_min_dist(px, py, edges: Column) -> Column:
    return let(
        pt(px, py),
        lambda p: F.array_min(
            F.transform(edges, lambda e: seg_dist(p["x"], p["y"], e["ax"], e["ay"], e["bx"], e["by"]))
        ),
    )


def point_in_ring(p: Column, ring: Column) -> Column:
    return edges_contain(p["x"], p["y"], ring_edges(ring))


def ring_min_edge_dist(p: Column, ring: Column) -> Column:
    return edges_min_dist(p["x"], p["y"], ring_edges(ring))


def edges_cross(e: Column, f: Column) -> Column:
    """Proper crossing of two edges (touching ends do not count)."""

    def side(ax, ay, bx, by, px, py):
        return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    d1 = side(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    d2 = side(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    d3 = side(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    d4 = side(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def rings_overlap(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Positive-area overlap: an edge crossing, or a vertex / edge middle /
    vertex mean of one ring strictly inside the other."""
    def strictly_inside(x, y, edges):
        return edges_contain(x, y, edges) & (edges_min_dist(x, y, edges) > eps)

    def any_inside(edges, other):
        return F.exists(
            edges,
            lambda e: strictly_inside(e["ax"], e["ay"], other)
            | strictly_inside((e["ax"] + e["bx"]) / 2, (e["ay"] + e["by"]) / 2, other),
        )

    def overlap(k):
        ea, eb, ma, mb = k["ea"], k["eb"], k["ma"], k["mb"]
        return (
            F.exists(ea, lambda e: F.exists(eb, lambda f: edges_cross(e, f)))
            | any_inside(ea, eb)
            | any_inside(eb, ea)
            | strictly_inside(ma["x"], ma["y"], eb)
            | strictly_inside(mb["x"], mb["y"], ea)
        )

    prepared = F.struct(
        ring_edges(a).alias("ea"), ring_edges(b).alias("eb"),
        vertex_mean(a).alias("ma"), vertex_mean(b).alias("mb"),
    )
    return (F.size(a) >= 3) & (F.size(b) >= 3) & let(prepared, overlap)


def simplify_ring(ring: Column, tol: float = 0.03) -> Column:
    """Drop near-duplicate, then near-collinear vertices."""

    def dedupe(r):
        return F.filter(r, lambda p, i: dist(p, nth(r, i - 1)) > tol)

    def straighten(r):
        def bend(b, i):
            a, c = nth(r, i - 1), nth(r, i + 1)
            return F.abs(
                (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
            ) > tol

        return F.filter(r, bend)

    def choose(d):
        return F.when(F.size(d) < 3, ring).otherwise(
            let(straighten(d), lambda s: F.when(F.size(s) >= 3, s).otherwise(d))
        )

    return F.when(F.size(ring) < 3, ring).otherwise(let(dedupe(ring), choose))


def _steps(start: Column, stop: Column, step: Column, inclusive: bool) -> Column:
    """start, start+step, ... up to stop, as doubles."""
    n = (stop - start) / step
    last = F.floor(n) if inclusive else F.ceil(n) - 1
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: start + i * step),
    ).otherwise(F.array().cast("array<double>"))


def interior_point(ring: Column) -> Column:
    """The centroid if inside, else the middle of the first inside span on the
    centroid's scanline."""
    def spot(k):
        c, b, edges = k["c"], k["b"], k["edges"]
        step = F.greatest((b["x1"] - b["x0"]) / 128, F.lit(0.25))
        marks = F.transform(
            _steps(b["x0"], b["x1"], step, True),
            lambda x: F.struct(x.alias("x"), edges_contain(x, c["y"], edges).alias("inside")),
        )

        def first_span(m):
            start = F.get(F.filter(m, lambda v: v["inside"]), F.lit(0))["x"]
            out = F.get(F.filter(m, lambda v: ~v["inside"] & (v["x"] > start)), F.lit(0))["x"]
            return (
                F.when(start.isNull(), c)
                .when(out.isNull(), pt((start + b["x1"]) / 2, c["y"]))
                .otherwise(pt((start + out - step) / 2, c["y"]))
            )

        return F.when(edges_contain(c["x"], c["y"], edges), c).otherwise(let(marks, first_span))

    return let(
        F.struct(
            polygon_centroid(ring).alias("c"), bbox(ring).alias("b"), ring_edges(ring).alias("edges")
        ),
        spot,
    )


def sample_points(ring: Column, step: float = 8.0) -> Column:
    """Interior samples of a grid of one step for rings of any size; a ring
    that catches none yields its interior point."""
    def grid(k):
        b, edges = k["b"], k["edges"]
        s = F.lit(float(step))
        xs = _steps(b["x0"] + s / 2, b["x1"], s, False)
        ys = _steps(b["y0"] + s / 2, b["y1"], s, False)
        points = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: pt(x, y))))
        return F.filter(points, lambda p: edges_contain(p["x"], p["y"], edges))

    hit = let(F.struct(bbox(ring).alias("b"), ring_edges(ring).alias("edges")), grid)
    return let(hit, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(interior_point(ring))))


def round_corners(pts: Column, radius: float = 0.75) -> Column:
    """Cut each inner corner, at most `radius` and 45 % of either leg."""
    n = F.size(pts)

    def corner(v, i):
        a, b = F.get(pts, i - 1), F.get(pts, i + 1)
        av, vb = dist(v, a), dist(b, v)
        cut = F.least(F.lit(radius), av * 0.45, vb * 0.45)
        sa, sb = F.when(av >= 1e-9, av), F.when(vb >= 1e-9, vb)
        pair = F.array(
            pt(v["x"] + (a["x"] - v["x"]) * cut / sa, v["y"] + (a["y"] - v["y"]) * cut / sa),
            pt(v["x"] + (b["x"] - v["x"]) * cut / sb, v["y"] + (b["y"] - v["y"]) * cut / sb),
        )
        keep = (i == 0) | (i == n - 1) | (av < 1e-9) | (vb < 1e-9)
        return F.when(keep, F.array(v)).otherwise(pair)

    return F.when(n < 3, pts).otherwise(F.flatten(F.transform(pts, corner)))
