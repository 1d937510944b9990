"""Camera optics: vertical view, ground band, pixel density, PTZ steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .geometry import clamp, lit, pt, round_half_up

ARC_STEP_DEG = 4
# EN 62676-4 pixel densities, px per metre, finest first.
DORI_PX = {"identify": 250, "recognise": 125, "observe": 62, "detect": 25}
DEFAULT_MOUNT_M = 4.0


def is_full(kind: Column, fov: Column) -> Column:
    """Sees all round: a dome, or a field of view of 360 degrees and more."""
    return (kind == "dome") | (fov >= 360)


def half_fov(kind: Column, fov: Column) -> Column:
    return F.when(is_full(kind, fov), F.lit(math.pi)).otherwise(F.radians(fov) / 2)


def vertical_half_fov(fov: Column, vfov: Column) -> Column:
    deg = F.when(vfov.isNotNull(), clamp(vfov, 1, 179)).otherwise(clamp(fov * (9 / 16), 15, 60))
    return deg * F.lit(math.pi / 360)


def tilt_band(kind, fov, tilt, mount, vfov) -> Column:
    """struct<near_m, far_m> of visible ground, NULL for untilted and all-round
    cameras. far_m is infinite once the upper edge reaches the horizon."""
    vh = vertical_half_fov(fov, vfov)
    lower, upper = F.radians(tilt) + vh, F.radians(tilt) - vh
    h = F.greatest(F.coalesce(mount, F.lit(DEFAULT_MOUNT_M)), F.lit(0.0))
    steep = (lower > 0) & (lower < math.pi / 2)
    near = F.greatest(
        F.lit(0.0), F.when(steep, h / F.tan(F.when(steep, lower))).otherwise(F.lit(0.0))
    )
    below = upper > 0.035
    far = F.when(below, h / F.tan(F.when(below, upper))).otherwise(F.lit(float("inf")))
    return F.when(
        tilt.isNotNull() & ~is_full(kind, fov),
        F.struct(near.alias("near_m"), F.greatest(near, far).alias("far_m")),
    )


def derive_vfov_deg(fov: Column) -> Column:
    h = clamp(fov, 1, 179)
    return F.degrees(F.atan(F.tan(h * F.lit(math.pi / 360)) * (9 / 16)) * 2)


def px_per_metre(kind: Column, fov: Column, mp: Column, dist_m) -> Column:
    """Horizontal pixels per metre at a distance; 0 means unrated."""
    d = lit(dist_m)
    use = F.when(is_full(kind, fov), F.lit(179.0)).otherwise(clamp(fov, 1, 179))
    ok = F.coalesce((mp > 0) & (d > 0) & (d < float("inf")), F.lit(False))
    width = F.sqrt(mp * 1e6 / 144) * 16
    scene = F.when(ok, d * 2 * F.tan(use * F.lit(math.pi / 360)))
    return F.when(ok & (scene > 0), width / F.when(scene > 0, scene)).otherwise(F.lit(0.0))


def dori_band(px: Column) -> Column:
    out = F.when(px.isNull() | (px <= 0) | (px == float("inf")) | F.isnan(px), F.lit(None))
    for band, floor in DORI_PX.items():
        out = out.when(px >= floor, F.lit(band))
    return out.otherwise(F.lit("below"))


def dori_range_m(kind: Column, fov: Column, mp: Column, band: str) -> Column:
    return px_per_metre(kind, fov, mp, 1.0) / DORI_PX[band]


def model_range_m(kind: Column, fov: Column, mp: Column) -> Column:
    """Farthest distance that still rates "observe", one decimal, at most 60 m."""
    r = px_per_metre(kind, fov, mp, 1.0) / DORI_PX["observe"]
    return F.least(F.lit(60.0), round_half_up(r * 10) / 10)


def norm_heading(h: Column) -> Column:
    return F.pmod(h, F.lit(360.0))


def pan_step(heading: Column, direction: Column) -> Column:
    return norm_heading(heading + direction * 5)


def zoom_step(fov: Column, rng: Column, direction: Column) -> Column:
    """struct<fov_deg, range_m> after one zoom press (+1 in, -1 out)."""
    nxt = clamp(F.when(direction == 1, fov / 1.25).otherwise(fov * 1.25), 20, 120)
    return F.struct(
        nxt.alias("fov_deg"),
        F.when(nxt == fov, rng).otherwise(rng * F.sqrt(fov / nxt)).alias("range_m"),
    )


def tilt_step(tilt: Column, direction: Column) -> Column:
    return clamp(F.coalesce(tilt, F.lit(35.0)) + direction * 5, 12, 80)


def default_mount_m(ceiling: Column) -> Column:
    return F.least(F.greatest(F.lit(4.0), ceiling - 0.6), F.lit(7.0))


def sector_ring(at, heading, kind, fov, rng) -> Column:
    """Plain wedge (apex + arc) or circle, ignoring walls."""
    full, half = is_full(kind, fov), half_fov(kind, fov)
    n = F.greatest(F.lit(1), F.ceil(half * 2 / F.lit(math.radians(ARC_STEP_DEG))).cast("int"))
    arc = F.transform(
        F.sequence(F.lit(0), F.when(full, n - 1).otherwise(n)),
        lambda i: pt(
            at["x"] + F.cos(F.radians(heading) - half + half * 2 * i / n) * rng,
            at["y"] + F.sin(F.radians(heading) - half + half * 2 * i / n) * rng,
        ),
    )
    return F.when(full, arc).otherwise(F.concat(F.array(pt(at["x"], at["y"])), arc))
