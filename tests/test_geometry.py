import math

import pytest
from pyspark.sql import functions as F

from floorlens.functions import geometry as g, labels, optics
from helpers import one, pts


def ring(points):
    return F.array(*[g.pt(x, y) for x, y in points])


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
ELL = [(0, 0), (20, 0), (20, 2), (2, 2), (2, 20), (0, 20)]


def test_area_centroid_perimeter(spark):
    r = ring(SQUARE)
    assert one(spark, g.polygon_area(r)) == 16
    assert tuple(one(spark, g.polygon_centroid(r))) == (2, 2)
    assert one(spark, g.polygon_perimeter(r)) == 16
    assert one(spark, g.path_length(r)) == 12
    assert tuple(one(spark, g.polygon_centroid(ring([(0, 0), (2, 0), (4, 0)])))) == (2, 0)


def test_point_in_ring_and_distances(spark):
    r = ring(SQUARE)
    assert one(spark, g.point_in_ring(g.pt(1, 1), r))
    assert not one(spark, g.point_in_ring(g.pt(5, 1), r))
    assert one(spark, g.ring_min_edge_dist(g.pt(1, 2), r)) == 1
    assert tuple(one(spark, g.nearest_on_polygon(g.pt(7, 1), r))) == (4, 1)


def test_interior_point_of_reentrant_room(spark):
    p = one(spark, g.interior_point(ring(ELL)))
    assert one(spark, g.point_in_ring(g.pt(p.x, p.y), ring(ELL)))
    assert len(one(spark, g.sample_points(ring(SQUARE)))) == 1
    assert all(one(spark, g.point_in_ring(g.pt(q.x, q.y), ring(ELL))) for q in one(spark, g.sample_points(ring(ELL), 4.0)))


def test_projection_round_trip(spark):
    lng, lat = F.lit(-120.0), F.lit(30.0)
    p = g.m2ll(lng, lat, g.pt(12.5, 7.25))
    back = one(spark, g.ll2m(lng, lat, p[0], p[1]))
    assert back.x == pytest.approx(12.5) and back.y == pytest.approx(7.25)


def test_snap_wrap_and_corners(spark):
    assert tuple(one(spark, g.snap_point(g.pt(1.3, -0.5), 1.0))) == (1, 0)
    assert tuple(one(spark, g.snap_point(g.pt(1.3, 0.2), 0.0))) == (1.3, 0.2)
    assert one(spark, g.wrap_pi(F.lit(3 * math.pi))) == pytest.approx(math.pi)
    assert one(spark, g.wrap_pi(F.lit(-math.pi))) == pytest.approx(math.pi)
    cut = one(spark, g.round_corners(ring([(0, 0), (10, 0), (10, 10)])))
    assert [tuple(p) for p in cut] == [(0, 0), (9.25, 0), (10, 0.75), (10, 10)]
    assert len(one(spark, g.column_polygon(g.pt(0, 0), F.lit(1.0)))) == 12


def test_overlap_needs_shared_area(spark):
    touch = [(4, 0), (8, 0), (8, 4), (4, 4)]
    over = [(3, 1), (8, 1), (8, 3), (3, 3)]
    inner = [(1, 1), (2, 1), (2, 2), (1, 2)]
    assert not one(spark, g.rings_overlap(ring(SQUARE), ring(touch)))
    assert one(spark, g.rings_overlap(ring(SQUARE), ring(over)))
    assert one(spark, g.rings_overlap(ring(SQUARE), ring(inner)))
    assert one(spark, g.rings_overlap(ring(SQUARE), ring(SQUARE)))


def test_simplify_ring(spark):
    noisy = [(0, 0), (2, 0), (2.001, 0), (4, 0), (4, 4), (0, 4)]
    assert len(one(spark, g.simplify_ring(ring(noisy)))) == 4


@pytest.mark.parametrize("tilt,mount,fov,vfov", [(20, 4, 60, None), (45, 2.5, 90, None), (30, None, 60, 40), (5, -1, 60, None), (16.875, 4, 60, None)])
def test_tilt_band(spark, tilt, mount, fov, vfov):
    f = lambda v: F.lit(None if v is None else float(v)).cast("double")
    b = one(spark, optics.tilt_band(F.lit("fixed"), f(fov), f(tilt), f(mount), f(vfov)))
    vh = math.radians((min(179, max(1, vfov)) if vfov else min(60, max(15, fov * 9 / 16))) / 2)
    lo, hi, h = math.radians(tilt) + vh, math.radians(tilt) - vh, max(4 if mount is None else mount, 0)
    assert b.near_m == pytest.approx(h / math.tan(lo) if 0 < lo < math.pi / 2 else 0)
    assert b.far_m >= b.near_m >= 0 and not math.isnan(b.far_m)
    if hi > 0.035:
        assert b.far_m == pytest.approx(max(b.near_m, h / math.tan(hi)))
    else:
        assert math.isinf(b.far_m)
    assert one(spark, optics.tilt_band(F.lit("dome"), f(60), f(30), f(4), f(None))) is None


def test_dori_and_ptz(spark):
    k = F.lit("fixed")
    px = optics.px_per_metre(k, F.lit(90.0), F.lit(2.0), 10.0)
    assert one(spark, px) == pytest.approx(16 * math.sqrt(2e6 / 144) / 20)
    assert one(spark, optics.px_per_metre(k, F.lit(90.0), F.lit(None).cast("double"), 10.0)) == 0
    bands = {300: "identify", 130: "recognise", 70: "observe", 25: "detect", 3: "below", 0: None}
    for v, b in bands.items():
        assert one(spark, optics.dori_band(F.lit(float(v)))) == b
    assert one(spark, optics.pan_step(F.lit(358.0), F.lit(1))) == 3
    z = one(spark, optics.zoom_step(F.lit(90.0), F.lit(20.0), F.lit(1)))
    back = one(spark, optics.zoom_step(F.lit(z.fov_deg), F.lit(z.range_m), F.lit(-1)))
    assert back.fov_deg == pytest.approx(90) and back.range_m == pytest.approx(20)
    assert one(spark, optics.zoom_step(F.lit(20.0), F.lit(30.0), F.lit(1))).range_m == 30
    assert one(spark, optics.tilt_step(F.lit(None).cast("double"), F.lit(1))) == 40


def test_labels(spark):
    f = lambda v: F.lit(v).cast("double")
    assert one(spark, labels.opening_style(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("retail"))) == "storefront"
    assert one(spark, labels.opening_default_width(F.lit("storefront"), F.lit(60.0))) == 26
    assert one(spark, labels.opening_default_width(F.lit("door"), F.lit(60.0))) == 0.95
    e = one(spark, labels.structure_extent(f(5), f(4), F.lit(3.2)))
    assert (e.base_m, e.top_m) == (3.2, 3.2)
    assert one(spark, labels.format_area(F.lit(1234.5))) == "1,235 m²"
    assert one(spark, labels.format_length(F.lit(10.0), "ft")) == "32.8 ft"
    assert pts([(1, 2)]) == [(1.0, 2.0)]
