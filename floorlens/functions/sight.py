"""Points against rings, a batch of pairs at a time.

The same tests as ``edges_contain``, ``edges_min_dist`` and ``rings_overlap`` of
``geometry``, with the same arithmetic, for joins that make many pairs with long
rings. Spark makes and partitions the pairs; a task looks at them in slices of
about `SLICE` point-edge pairs, so memory does not grow with a batch. Rings are
finite arrays of points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

SLICE = 1_000_000
#: Scanlines of one call of `line_runs`.
BAND = 256
EPS_M = 1e-9


class _Rings:
    """Edges of a slice of rings: corner arrays, and where each ring's start."""

    def __init__(self, x: pa.Array, y: pa.Array):
        self.counts = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)
        self.ax, self.ay = (v.flatten().to_numpy(zero_copy_only=False) for v in (x, y))
        after = np.arange(len(self.ax)) + 1
        full = self.counts > 0
        after[(self.starts + self.counts - 1)[full]] = self.starts[full]
        self.bx, self.by = self.ax[after], self.ay[after]

    def against(self, rows: np.ndarray):
        """(item, edge, first pair of each item) for items that meet every edge
        of the ring of their row."""
        n = self.counts[rows]
        first = np.cumsum(n) - n
        item = np.repeat(np.arange(len(rows)), n)
        return item, np.arange(n.sum()) + np.repeat(self.starts[rows] - first, n), first

    def hold(self, px: np.ndarray, py: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Even-odd test, half-open in y."""
        if not len(rows):
            return np.zeros(0, bool)
        item, e, first = self.against(rows)
        x, y, ax, ay, bx, by = px[item], py[item], self.ax[e], self.ay[e], self.bx[e], self.by[e]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return np.add.reduceat(hit.astype(np.int64), first) % 2 == 1

    def nearest(self, px: np.ndarray, py: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distance to the nearest edge."""
        if not len(rows):
            return np.zeros(0)
        item, e, first = self.against(rows)
        x, y, ax, ay = px[item], py[item], self.ax[e], self.ay[e]
        dx, dy = self.bx[e] - ax, self.by[e] - ay
        l2 = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(l2 == 0, 0.0, np.minimum(np.maximum(((x - ax) * dx + (y - ay) * dy) / l2, 0.0), 1.0))
        ox, oy = x - (ax + t * dx), y - (ay + t * dy)
        return np.fmin.reduceat(np.sqrt(ox * ox + oy * oy), first)

    def strictly_hold(self, px: np.ndarray, py: np.ndarray, rows: np.ndarray) -> np.ndarray:
        held = self.hold(px, py, rows)
        held[held] = self.nearest(px[held], py[held], rows[held]) > EPS_M
        return held

    def marks(self):
        """Corners, edge middles and vertex mean of each ring, with their row."""
        size = len(self.counts)
        with np.errstate(invalid="ignore"):
            mean = [np.bincount(self.rows, v, size) / self.counts for v in (self.ax, self.ay)]
        x = np.concatenate([self.ax, (self.ax + self.bx) / 2, mean[0]])
        y = np.concatenate([self.ay, (self.ay + self.by) / 2, mean[1]])
        return x, y, np.concatenate([self.rows, self.rows, np.arange(size)])


def _slices(cost: np.ndarray):
    """Ranges of rows that cost about `SLICE` each."""
    part = np.cumsum(cost) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(cost)])


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def depths(px: pa.Array, py: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Distance from each point to the outline of its ring; null outside."""
    px, py = (v.to_numpy(zero_copy_only=False) for v in (px, py))
    out, n = np.full(len(px), np.nan), _lengths(x)
    for i, j in _slices(n) if len(n) else ():
        rings, rows = _Rings(x.slice(i, j - i), y.slice(i, j - i)), np.flatnonzero(n[i:j])
        qx, qy = px[i:j][rows], py[i:j][rows]
        held = rings.hold(qx, qy, rows)
        out[i + rows[held]] = rings.nearest(qx[held], qy[held], rows[held])
    return pa.array(out, from_pandas=True)


def held(px: pa.Array, py: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether each point lies in its ring."""
    px, py = (v.to_numpy(zero_copy_only=False) for v in (px, py))
    out, n = np.zeros(len(px), bool), _lengths(x)
    for i, j in _slices(n) if len(n) else ():
        rows = np.flatnonzero(n[i:j])
        out[i + rows] = _Rings(x.slice(i, j - i), y.slice(i, j - i)).hold(px[i:j][rows], py[i:j][rows], rows)
    return pa.array(out)


def _meet(a: _Rings, b: _Rings, open_: np.ndarray) -> np.ndarray:
    """Rows among `open_` where an edge of `a` properly crosses one of `b`."""
    some = np.flatnonzero(open_[a.rows])
    if not len(some):
        return np.zeros(len(open_), bool)
    item, f, first = b.against(a.rows[some])
    e = some[item]
    side = lambda p, i, x, y: np.sign((p.bx[i] - p.ax[i]) * (y - p.ay[i]) - (p.by[i] - p.ay[i]) * (x - p.ax[i]))
    apart = side(a, e, b.ax[f], b.ay[f]) * side(a, e, b.bx[f], b.by[f]) < 0
    apart &= side(b, f, a.ax[e], a.ay[e]) * side(b, f, a.bx[e], a.by[e]) < 0
    out = np.zeros(len(open_), bool)
    out[a.rows[some][np.logical_or.reduceat(apart, first)]] = True
    return out


def overlaps(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    """Whether the rings of each row share area."""
    na, nb = _lengths(ax), _lengths(bx)
    out = np.zeros(len(na), bool)
    for i, j in _slices(na * nb * 3) if len(na) else ():
        a, b = _Rings(ax.slice(i, j - i), ay.slice(i, j - i)), _Rings(bx.slice(i, j - i), by.slice(i, j - i))
        open_ = (na[i:j] >= 3) & (nb[i:j] >= 3)
        found = _meet(a, b, open_)
        for one, other in ((b, a), (a, b)):
            x, y, rows = one.marks()
            left = (open_ & ~found)[rows]
            x, y, rows = x[left], y[left], rows[left]
            found[rows[other.strictly_hold(x, y, rows)]] = True
        out[i:j] = found
    return pa.array(out)


RUN = pa.struct([("line", pa.int64()), ("x1", pa.float64()), ("x2", pa.float64())])


def runs(x: pa.Array, y: pa.Array, band: pa.Array, pitch: pa.Array) -> pa.Array:
    """Inside intervals (line, x1, x2) of each ring on the scanlines of one band."""
    size = len(x)
    rings, step = _Rings(x, y), pitch[0].as_py() if size else 1.0
    first = band.to_numpy(zero_copy_only=False).astype(np.int64)[rings.rows] * BAND
    line_at = lambda v: np.clip(np.ceil(v / step - 0.5), first, first + BAND).astype(np.int64)
    lo, hi = line_at(np.minimum(rings.ay, rings.by)), line_at(np.maximum(rings.ay, rings.by))
    n = hi - lo
    ends = np.concatenate((rings.starts, [len(n)]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for i, j in _slices(np.bincount(rings.rows, n, size)) if size else ():
        edges = np.arange(ends[i], ends[j])
        each = n[edges]
        e = np.repeat(edges, each)
        line = lo[e] + np.arange(len(e)) - np.repeat(np.cumsum(each) - each, each)
        ax, ay, bx, by = rings.ax[e], rings.ay[e], rings.bx[e], rings.by[e]
        at = (bx - ax) * ((line + 0.5) * step - ay) / (by - ay) + ax
        ring = rings.rows[e]
        order = np.lexsort((at, line, ring))
        ring, line, at = ring[order], line[order], at[order]
        same = (ring[1:] == ring[:-1]) & (line[1:] == line[:-1])
        fresh = np.flatnonzero(np.concatenate(([True], ~same))) if len(e) else np.zeros(0, np.int64)
        nth = np.arange(len(e)) - np.repeat(fresh, np.diff(np.append(fresh, len(e))))
        kept = np.flatnonzero(same & (nth[:-1] % 2 == 0) & (at[1:] > at[:-1]))
        found.append((ring[kept], line[kept], at[kept], at[kept + 1]))
    ring, line, x1, x2 = (np.concatenate(c) for c in zip(*found, strict=True))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(ring, minlength=size)))).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(line), pa.array(x1), pa.array(x2)], fields=list(RUN))
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


# A filter on these would else be pushed below the column and evaluate it again.
_depths = F.arrow_udf(depths, DoubleType()).asNondeterministic()
_held = F.arrow_udf(held, BooleanType())
_overlaps = F.arrow_udf(overlaps, BooleanType())
_runs = F.arrow_udf(runs, ArrayType(StructType().add("line", LongType()).add("x1", DoubleType()).add("x2", DoubleType())))


def ring_depth(p: Column, ring: Column) -> Column:
    """Distance from a point inside the ring to its outline; NULL outside."""
    return _depths(p["x"], p["y"], ring["x"], ring["y"])


def ring_holds(p: Column, ring: Column) -> Column:
    """Even-odd test of a point in a ring."""
    return _held(p["x"], p["y"], ring["x"], ring["y"])


def rings_overlap(a: Column, b: Column) -> Column:
    """Positive-area overlap, by the rules of ``geometry.rings_overlap``."""
    return _overlaps(a["x"], a["y"], b["x"], b["y"])


def line_runs(ring: Column, band: Column, pitch: float) -> Column:
    """Inside intervals (line, x1, x2) of a ring on scanlines `pitch` apart, of
    those in one band of `BAND` lines (even-odd)."""
    return _runs(ring["x"], ring["y"], band, F.lit(float(pitch)))
