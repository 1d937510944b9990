"""Regions and outlines over many small tiles, against flood fill."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlens.functions import geometry as g
from floorlens.operators import regions

RUN = "building_id long, ordinal int, line long, x1 double, x2 double"


def flood(cells, diagonal=False):
    """4-connected (or 8-connected) groups of a set of cells."""
    left, groups = set(cells), []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            c = todo.pop()
            group.add(c)
            for dx, dy in steps:
                n = (c[0] + dx, c[1] + dy)
                if n in left:
                    left.discard(n)
                    todo.append(n)
        groups.append(group)
    return groups


def scene(shape, share, seed):
    """Cells (column, line) of a random picture, off the origin."""
    picture = np.random.default_rng(seed).random(shape) < share
    return {(int(x) - 5, int(y) - 3) for y, x in np.argwhere(picture)}


def run_rows(cells, building=1):
    out = []
    for x, y in sorted(cells, key=lambda c: (c[1], c[0])):
        if out and out[-1][2] == y and out[-1][4] == x:
            out[-1][4] = float(x + 1)
        else:
            out.append([building, 0, y, float(x), float(x + 1)])
    return [tuple(r) for r in out]


def spiral(n):
    """One corridor wound up: a single region whose outline crosses every tile."""
    cells, x, y, dx, dy = {(0, 0)}, 0, 0, 1, 0
    for length in range(2, n, 2):
        for _ in range(2):
            for _ in range(length):
                x, y = x + dx, y + dy
                cells.add((x, y))
            dx, dy = -dy, dx
    return cells


PICTURES = [scene((24, 30), 0.55, 1), scene((30, 24), 0.4, 2), scene((20, 20), 0.75, 3), spiral(24), {(0, 0), (1, 1), (1, 0), (0, 2)}]


@pytest.mark.parametrize("tile", [4.0, 64.0])
def test_regions_and_outlines_equal_flood_fill(spark, tile):
    rows = [r for b, cells in enumerate(PICTURES) for r in run_rows(cells, b)]
    of = spark.createDataFrame(rows, RUN)
    got = regions.regions(of, 1.0, tile).collect()
    rings = regions.outlines_of(of, 1.0, tile).withColumn("signed", F.when(F.col("hole"), -g.polygon_area(F.col("ring"))).otherwise(g.polygon_area(F.col("ring")))).collect()
    for b, cells in enumerate(PICTURES):
        groups = flood(cells)
        want = sorted((len(c), min(x for x, _ in c), max(x for x, _ in c) + 1, min(y for _, y in c), max(y for _, y in c) + 1) for c in groups)
        assert sorted((r.area_m2, r.x0, r.x1, r.y0, r.y1) for r in got if r.building_id == b) == want
        own = [r for r in rings if r.building_id == b]
        assert sum(not r.hole for r in own) == len(groups)
        box = {(x, y) for x in range(-7, 45) for y in range(-7, 45)} | {(x, y) for x in range(-40, 45) for y in range(-40, 45)}
        assert sum(r.hole for r in own) == len(flood(box - cells, diagonal=True)) - 1
        assert sum(r.signed for r in own) == len(cells) and all(abs(r.signed) == r.area_m2 for r in own)
        for r in own:  # axis-parallel, no vertex on a straight line, closed by its first point
            p = [(v.x, v.y) for v in r.ring]
            turns = [(p[i][0] == p[i - 1][0]) for i in range(len(p))]
            assert len(p) % 2 == 0 and all(turns[i] != turns[i - 1] for i in range(len(p)))


def test_no_runs_give_no_regions(spark):
    of = spark.createDataFrame([], RUN)
    assert regions.regions(of).collect() == [] and regions.outlines_of(of).collect() == []
