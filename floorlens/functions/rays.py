"""Rays of cameras against walls, a camera's sector at a time.

The same arithmetic as ``geometry.seg_dist`` and ``ray_segment_t``. Spark gathers the
walls of a camera; rays and walls meet in slices of about `SLICE` pairs. What takes sines or arc
tangents of a ray comes from Spark's expressions; here an angle only tells in
which sector a ray is worked on, and walls are held a little beyond theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

SLICE = 1_000_000
#: Rays go this far to both sides of a corner, too.
EPS_RAD = 1e-4
#: Walls this far out of view are still held.
MARGIN_RAD = 0.01
HIT = ("rel", "dist", "ux", "uy")


def nearest(ox: float, oy: float, r: float, ux, uy, ax, ay, bx, by) -> np.ndarray:
    """Distance along each unit ray to the nearest segment, `r` at most."""
    out = np.full(len(ux), r)
    if not len(ax):
        return out
    ex, ey, px, py = bx - ax, by - ay, ax - ox, ay - oy
    across = px * ey - py * ex
    step = max(1, SLICE // len(ax))
    for i in range(0, len(ux), step):
        dx, dy = ux[i : i + step, None], uy[i : i + step, None]
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = across / den, (px * dy - py * dx) / den
        hit = (np.abs(den) >= 1e-12) & (t >= 0) & (u >= 0) & (u <= 1)
        out[i : i + step] = np.minimum(np.where(hit, t, r).min(1), r)
    return out


def _corner_rays(ox, oy, full, half, x, y, rel):
    """Rays aimed along the exact offset to a corner, so that whether they
    touch it does not hang on the last bit of a cosine."""
    aimed = full | (np.abs(rel) <= half + EPS_RAD)
    dx, dy, rel = x[aimed] - ox, y[aimed] - oy, rel[aimed]
    ln = np.sqrt(dx * dx + dy * dy)
    apart = ln > 0
    ln[~apart] = 1.0
    ex, ey = np.where(apart, dx / ln, 1.0), np.where(apart, dy / ln, 0.0)
    ce, se = math.cos(EPS_RAD), math.sin(EPS_RAD)
    return (
        np.concatenate((rel - EPS_RAD, rel, rel + EPS_RAD)),
        np.concatenate((ex * ce + ey * se, ex, ex * ce - ey * se)),
        np.concatenate((ey * ce - ex * se, ey, ey * ce + ex * se)),
    )


def _sector_rays(rel, ux, uy):
    """The rays in angle order, equal ones once."""
    order = np.lexsort((uy, ux, rel))
    rel, ux, uy = rel[order], ux[order], uy[order]
    fresh = np.ones(len(rel), bool)
    fresh[1:] = (rel[1:] != rel[:-1]) | (ux[1:] != ux[:-1]) | (uy[1:] != uy[:-1])
    return rel[fresh], ux[fresh], uy[fresh]


def _hits(x, y, r, full, half, sectors, arc_rel, arc_ux, arc_uy, sector, ax, ay, bx, by, rel_a, rel_b):
    lists = (arc_rel, arc_ux, arc_uy, sector, ax, ay, bx, by, rel_a, rel_b)
    arc, many = (v.value_lengths().to_numpy(zero_copy_only=False) for v in (arc_rel, ax))
    values = [v.flatten().to_numpy(zero_copy_only=False) for v in lists]
    rows = zip(*(v.to_pylist() for v in (x, y, r, full, half, sectors)), strict=True)
    ends = np.cumsum(arc), np.cumsum(many)
    found, size = [[np.zeros(0)] for _ in HIT], [0]
    for i, (ox, oy, reach, all_round, wide, n) in enumerate(rows):
        a, w = slice(ends[0][i] - arc[i], ends[0][i]), slice(ends[1][i] - many[i], ends[1][i])
        aim, walls = [v[a] for v in values[:3]], [v[w] for v in values[3:]]
        if n > 1:
            order = np.argsort(walls[0], kind="stable")
            walls = [v[order] for v in walls]
        bounds = np.searchsorted(walls[0], np.arange(n + 1))
        size.append(0)
        for k in range(n):
            ax_, ay_, bx_, by_, ra, rb = (v[bounds[k] : bounds[k + 1]] for v in walls[1:])
            around = _corner_rays(ox, oy, all_round, wide, np.append(ax_, bx_), np.append(ay_, by_), np.append(ra, rb))
            rel, ux, uy = (np.append(v, c) for v, c in zip(aim, around, strict=True))
            if n > 1:
                own = np.floor((np.arctan2(uy, ux) + math.pi) / (2 * math.pi) * n).astype(np.int64) % n == k
                rel, ux, uy = rel[own], ux[own], uy[own]
            rel, ux, uy = _sector_rays(rel, ux, uy)
            for column, value in zip(found, (rel, nearest(ox, oy, reach, ux, uy, ax_, ay_, bx_, by_), ux, uy), strict=True):
                column.append(value)
            size[-1] += len(rel)
    made = pa.StructArray.from_arrays([pa.array(np.concatenate(v)) for v in found], list(HIT))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), made)


def _gap(x, y, h, full, half, reach, ax, ay, bx, by):
    x, y, h, full, half, reach, ax, ay, bx, by = (v.to_numpy(zero_copy_only=False) for v in (x, y, h, full, half, reach, ax, ay, bx, by))
    ex, ey = bx - ax, by - ay
    length = ex * ex + ey * ey
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(length == 0, 0.0, np.minimum(np.maximum(((x - ax) * ex + (y - ay) * ey) / length, 0.0), 1.0))
    dx, dy = x - (ax + t * ex), y - (ay + t * ey)
    gap = np.sqrt(dx * dx + dy * dy)
    wrapped = lambda v: v - 2 * math.pi * np.ceil((v - math.pi) / (2 * math.pi))
    t_a, t_b = np.arctan2(ay - y, ax - x), np.arctan2(by - y, bx - x)
    turn = wrapped(t_b - t_a)
    off = np.abs(wrapped(t_a + turn / 2 - h))
    seen = full | (gap < 1e-6) | (off <= half + np.abs(turn) / 2 + MARGIN_RAD)
    return pa.array(gap, mask=~(seen & (gap <= reach)))


def _type() -> ArrayType:
    kind = StructType()
    for name in HIT:
        kind = kind.add(name, DoubleType())
    return ArrayType(kind)


_stops = F.arrow_udf(_hits, _type())
# A filter on it would else be pushed below the column and evaluate it again.
_gaps = F.arrow_udf(_gap, DoubleType()).asNondeterministic()


def gap(cam: Column, reach: Column, a: Column, b: Column) -> Column:
    """Distance of wall a-b from the camera; NULL beyond `reach` or out of view."""
    return _gaps(*[cam[k] for k in ("x", "y", "h", "full", "half")], reach, a["x"], a["y"], b["x"], b["y"])


def stops(cam: Column, sectors: Column, arc: Column, walls: Column, ends: Column) -> Column:
    """array<struct<rel, dist, ux, uy>>: the rays of a camera, those of `arc` and those
    at the corners of `walls` (`ends`: their offsets from the heading)."""
    pose = [cam[k] for k in ("x", "y", "r", "full", "half")]
    sides = [walls[k] for k in ("sector", "ax", "ay", "bx", "by")]
    return _stops(*pose, sectors, *[arc[k] for k in ("rel", "ux", "uy")], *sides, ends["a"], ends["b"])
