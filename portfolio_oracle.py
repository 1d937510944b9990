"""DuckDB SQL for the derived portfolio: shared table expressions.

The SQL is written from the rules, on rectangles and plain columns, not from
the Spark plans, so the two sides check each other.
"""

from __future__ import annotations

import math
import re

from floorlens.sources.catalogue import CAMERA_MODELS
from floorlens.sources.scene import AMENITIES, CATS, FIXTURES, INCIDENTS, STATUSES

PI = repr(math.pi)
TWO_PI = repr(2 * math.pi)
CE, SE = repr(math.cos(1e-4)), repr(math.sin(1e-4))


def _list(v):
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(float(x)) for x in v) + "]"


SPACE = "category NOT IN ('corridor','elevator','stairs','outside')"

SCENE = f"""
nbt AS (SELECT max(p_partkey) AS last, max(p_partkey) // 60 + 1 AS nb FROM part),
rooms AS (
  SELECT p_partkey AS k, p_partkey // 60 AS building_id, CAST((p_partkey % 60) // 20 AS INTEGER) AS ordinal,
    p_partkey % 20 AS slot, CAST(p_partkey % 60 AS INTEGER) AS pos,
    CAST(((p_partkey % 20) // 2) * 6 AS DOUBLE) AS x0, CAST((p_partkey % 2) * 8 AS DOUBLE) AS y0,
    p_size, p_name, p_brand, p_type FROM part),
floors AS (SELECT DISTINCT building_id, ordinal FROM rooms),
levels AS (SELECT building_id, ordinal, 'Level ' || ordinal AS name,
  CASE ordinal WHEN 0 THEN 4.5::DOUBLE WHEN 2 THEN 2.8::DOUBLE END AS ceiling_m FROM floors),
buildings AS (SELECT DISTINCT building_id, CAST(building_id % 25 - 120 AS DOUBLE) AS lng0,
  (building_id % 25) / 2 + 30::DOUBLE AS lat0 FROM rooms),
units AS (
  SELECT building_id, ordinal, 'u' || k AS unit_id, pos,
    CASE WHEN p_size = 50 THEN '' ELSE p_name END AS name,
    CASE slot WHEN 18 THEN 'stairs' WHEN 19 THEN 'elevator' ELSE {_list(CATS)}[p_size % 8 + 1] END AS category,
    CASE WHEN p_size % 17 = 0 THEN 'restricted' WHEN p_size % 5 = 0 THEN 'secure' END AS security,
    x0, y0, x0 + 6 AS x1, y0 + 5 AS y1 FROM rooms
  UNION ALL SELECT building_id, ordinal, 'c' || building_id || '-' || ordinal, 60 + ordinal, 'Hall', 'corridor',
    NULL, 0::DOUBLE, 5::DOUBLE, 60::DOUBLE, 8::DOUBLE FROM floors
  UNION ALL SELECT building_id, ordinal, 'out' || building_id, 63, 'Yard', 'outside',
    NULL, 0::DOUBLE, (-8)::DOUBLE, 60::DOUBLE, (-2)::DOUBLE FROM floors WHERE ordinal = 0),
openings AS (
  SELECT building_id, 'd' || k AS opening_id, pos, 'u' || k AS unit_id, x0 + 3 AS ox,
    CASE WHEN y0 = 0 THEN 5::DOUBLE ELSE 8::DOUBLE END AS oy, NULL::VARCHAR AS kind FROM rooms WHERE p_size % 13 <> 0
  UNION ALL SELECT building_id, 'e' || k, 60, 'u' || k, 3::DOUBLE, 0::DOUBLE, 'entrance'
    FROM rooms WHERE slot = 0 AND ordinal = 0),
verticals AS (
  SELECT building_id, CAST(ordinal * 2 + slot - 18 AS INTEGER) AS pos, 'u' || k AS unit_a, 'u' || (k + 20) AS unit_b,
    CASE slot WHEN 18 THEN 'Stairs' ELSE 'Elevator' END AS name
  FROM rooms, nbt WHERE slot >= 18 AND ordinal < 2 AND k + 20 <= last),
occupants AS (
  SELECT building_id, ordinal, 'o' || k AS occupant_id, pos, 'u' || k AS unit_id, p_brand AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'retail' WHEN 'LARGE' THEN 'dining' WHEN 'MEDIUM' THEN 'services'
      WHEN 'PROMO' THEN 'entertainment' WHEN 'SMALL' THEN 'health' WHEN 'STANDARD' THEN 'office' END AS category,
    CASE WHEN k % 4 = 0 THEN x0 + 1 END AS ax, CASE WHEN k % 4 = 0 THEN y0 + 1 END AS ay
  FROM rooms WHERE p_size % 3 = 0 AND slot < 18),
cameras AS (
  SELECT c.k % nb AS building_id, CAST((c.k // nb) % 3 AS INTEGER) AS ordinal, 'cam' || c.k AS camera_id,
    CAST(c.k AS INTEGER) AS pos, (c.k * 37 % 473) / 8.0::DOUBLE + 0.4375::DOUBLE AS cx,
    (c.k * 11 % 99) / 8.0::DOUBLE + 0.3125::DOUBLE AS cy, CAST(c.k * 45 % 360 AS DOUBLE) AS heading,
    CASE c.k % 5 WHEN 0 THEN 360::DOUBLE WHEN 1 THEN 60::DOUBLE ELSE CAST(c.k % 5 * 5 + 90 AS DOUBLE) END AS fov,
    CAST(c.k % 13 + 8 AS DOUBLE) AS rng,
    CASE c.k % 5 WHEN 0 THEN 'dome' WHEN 1 THEN 'ptz' ELSE 'fixed' END AS kind, c_name AS name,
    CASE WHEN c.k % 7 = 3 AND c.k % 5 <> 0 THEN CAST(c.k % 30 + 20 AS DOUBLE) END AS tilt,
    CASE WHEN c.k % 7 = 3 THEN 3.0::DOUBLE END AS mount,
    CASE WHEN c.k % 3 = 0 THEN {_list([float(m[4]) for m in CAMERA_MODELS])}[c.k % 18 + 1]::DOUBLE END AS mp,
    CASE WHEN c.k % 4 = 0 THEN CAST(c.k + 1 AS INTEGER) END AS op_number,
    CASE WHEN c.k % 5 < 4 THEN {_list(STATUSES)}[c.k % 5 % 4 + 1] END AS status,
    CASE WHEN c.k % 3 <> 2 THEN DATE '2023-01-01' + CAST(c.k % 365 AS INTEGER) END AS serviced
  FROM (SELECT c_custkey AS k, c_name FROM customer) c, nbt
  WHERE (c.k % nb, (c.k // nb) % 3) IN (SELECT (building_id, ordinal) FROM floors)),
sup AS (
  SELECT s_suppkey AS k, s_suppkey % nb AS building_id, CAST((s_suppkey // nb) % 3 AS INTEGER) AS ordinal
  FROM supplier, nbt WHERE (s_suppkey % nb, (s_suppkey // nb) % 3) IN (SELECT (building_id, ordinal) FROM floors)),
structures AS (
  SELECT building_id, ordinal, 's' || k AS structure_id, CAST(k AS INTEGER) AS pos,
    CASE WHEN k % 3 = 0 THEN 'obstacle' ELSE 'column' END AS kind,
    CAST(k * 7 % 51 + 4 AS DOUBLE) + 0.25 AS x0, 6.25::DOUBLE AS y0,
    CAST(k * 7 % 51 + 4 AS DOUBLE) + 0.75 AS x1, 6.75::DOUBLE AS y1,
    CASE k % 5 WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS height_m,
    CASE WHEN k % 4 = 0 THEN 2.5::DOUBLE END AS base_m FROM sup),
amenities AS (
  SELECT building_id, ordinal, 'a' || k AS amenity_id, CAST(k AS INTEGER) AS pos,
    CAST(k * 13 % 60 AS DOUBLE) + 0.5 AS x, CAST(k * 5 % 13 AS DOUBLE) + 0.5 AS y,
    {_list(AMENITIES)}[k % 10 + 1] AS kind, CASE WHEN k % 2 = 0 THEN 'Amenity ' || k END AS name FROM sup),
fixtures AS (
  SELECT building_id, ordinal, 'f' || k AS fixture_id, pos, {_list(FIXTURES)}[p_size % 14 + 1] AS kind,
    x0 + 1 AS x0, y0 + 1 AS y0, x0 + 3 AS x1, y0 + 2 AS y1 FROM rooms WHERE p_size % 4 = 0),
probes AS (
  SELECT user_id % nb AS building_id, CAST(event_id % 3 AS INTEGER) AS ordinal, event_id AS probe_id,
    user_id AS subject, ts, event_type, (event_id * 7919 % 477) / 8.0::DOUBLE + 0.1875::DOUBLE AS px,
    (event_id * 104729 % 103) / 8.0::DOUBLE + 0.0625::DOUBLE AS py
  FROM events, nbt WHERE (user_id % nb, CAST(event_id % 3 AS INTEGER)) IN (SELECT (building_id, ordinal) FROM floors)),
incidents AS (
  SELECT *, 'i' || probe_id AS incident_id, {_list(INCIDENTS)}[probe_id % 7 + 1] AS kind
  FROM probes WHERE event_type = 'error'),
routes AS (
  SELECT c_custkey AS request_id, c_custkey % nb AS building_id,
    'u' || ((c_custkey % nb) * 60 + c_custkey * 7 % 60) AS start_id,
    'u' || ((c_custkey % nb) * 60 + (c_custkey * 13 + 5) % 60) AS goal_id
  FROM customer, nbt WHERE (c_custkey % nb) * 60 + c_custkey * 7 % 60 <= last
    AND (c_custkey % nb) * 60 + (c_custkey * 13 + 5) % 60 <= last)
"""


def _edges(src, key, table, where="TRUE"):
    parts = []
    for i, (a, b) in enumerate([("x0,y0", "x1,y0"), ("x1,y0", "x1,y1"), ("x1,y1", "x0,y1"), ("x0,y1", "x0,y0")]):
        ax, ay = a.split(",")
        bx, by = b.split(",")
        parts.append(
            f"SELECT building_id, ordinal, '{src}' AS source, {key} AS source_id, {i} AS pos, "
            f"{ax} AS ax, {ay} AS ay, {bx} AS bx, {by} AS by FROM {table} WHERE {where}"
        )
    return " UNION ALL ".join(parts)


WALLS = f"""
footprints AS (SELECT building_id, ordinal, 0::DOUBLE AS x0, 0::DOUBLE AS y0, 60::DOUBLE AS x1, 13::DOUBLE AS y1 FROM floors),
walls AS ({_edges('unit', 'unit_id', 'units')}
  UNION ALL {_edges('footprint', 'CAST(ordinal AS VARCHAR)', 'footprints')}
  UNION ALL {_edges('structure', 'structure_id', 'structures', 'coalesce(base_m, 0) < 1.8')}),
seg AS (
  SELECT building_id, ordinal, ax, ay, bx, by, count(*) AS copies FROM (
    SELECT building_id, ordinal, CASE WHEN f THEN ax ELSE bx END AS ax, CASE WHEN f THEN ay ELSE by END AS ay,
      CASE WHEN f THEN bx ELSE ax END AS bx, CASE WHEN f THEN by ELSE ay END AS by
    FROM (SELECT *, ax < bx OR (ax = bx AND ay <= by) AS f FROM walls)) GROUP BY ALL),
nwalls AS (SELECT building_id, ordinal, sum(copies) AS n FROM seg GROUP BY ALL)
"""


def wrap(a):
    return f"({a} - {TWO_PI} * ceil(({a} - {PI}) / {TWO_PI}))"


RINGS = f"""
pose0 AS (
  SELECT *, kind = 'dome' OR fov >= 360 AS full_, radians(heading) AS h,
    least(greatest(fov * 0.5625, 15), 60) * {repr(math.pi / 360)} AS vh FROM cameras),
pose1 AS (
  SELECT *, CASE WHEN full_ THEN {PI} ELSE radians(fov) / 2 END AS half,
    tilt IS NOT NULL AND NOT full_ AS banded, radians(tilt) + vh AS lo, radians(tilt) - vh AS hi,
    coalesce(mount, 4) AS mh FROM pose0),
pose2 AS (
  SELECT *, CASE WHEN banded AND lo > 0 AND lo < {repr(math.pi / 2)} THEN mh / tan(lo) ELSE 0 END AS near0,
    CASE WHEN banded AND hi > 0.035 THEN mh / tan(hi) END AS far0 FROM pose1),
pose AS (
  SELECT *, least(rng, greatest(coalesce(far0, rng), CASE WHEN banded AND far0 IS NOT NULL THEN near0 ELSE 0 END)) AS r FROM pose2),
local AS MATERIALIZED (
  SELECT p.building_id, p.ordinal, p.camera_id, s.ax, s.ay, s.bx, s.by
  FROM pose p JOIN nwalls n USING (building_id, ordinal) JOIN seg s USING (building_id, ordinal),
  LATERAL (SELECT least(greatest(((cx - ax) * (bx - ax) + (cy - ay) * (by - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)), 0), 1) AS t)
  WHERE sqrt((cx - (ax + t * (bx - ax))) * (cx - (ax + t * (bx - ax))) + (cy - (ay + t * (by - ay))) * (cy - (ay + t * (by - ay)))) <= r + 0.01),
corner0 AS (
  SELECT DISTINCT building_id, ordinal, camera_id, x, y FROM (
    SELECT building_id, ordinal, camera_id, ax AS x, ay AS y FROM local
    UNION ALL SELECT building_id, ordinal, camera_id, bx, by FROM local)),
corner AS (
  SELECT *, {wrap('(atan2(dy, dx) - h)')} AS rel0, dx / len AS ex, dy / len AS ey FROM (
    SELECT c.building_id, c.ordinal, c.camera_id, p.h, p.half, p.full_, x - cx AS dx, y - cy AS dy,
      sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS len
    FROM corner0 c JOIN pose p USING (building_id, ordinal, camera_id))),
rays AS (
  SELECT building_id, ordinal, camera_id, rel, any_value(ux) AS ux, any_value(uy) AS uy FROM (
    SELECT building_id, ordinal, camera_id, rel, cos(h + rel) AS ux, sin(h + rel) AS uy FROM (
      SELECT building_id, ordinal, camera_id, h, -half + half * 2 * i / n AS rel FROM (
        SELECT building_id, ordinal, camera_id, h, half, n, unnest(range(CASE WHEN full_ THEN n ELSE n + 1 END)) AS i FROM (
          SELECT *, greatest(1, CAST(ceil(half * 2 / {repr(math.radians(4))}) AS BIGINT)) AS n FROM pose)))
    UNION ALL SELECT building_id, ordinal, camera_id, rel0 - 1e-4::DOUBLE, ex * {CE} + ey * {SE}, ey * {CE} - ex * {SE}
      FROM corner WHERE full_ OR abs(rel0) <= half + 1e-4::DOUBLE
    UNION ALL SELECT building_id, ordinal, camera_id, rel0, ex, ey FROM corner WHERE full_ OR abs(rel0) <= half + 1e-4::DOUBLE
    UNION ALL SELECT building_id, ordinal, camera_id, rel0 + 1e-4::DOUBLE, ex * {CE} - ey * {SE}, ey * {CE} + ex * {SE}
      FROM corner WHERE full_ OR abs(rel0) <= half + 1e-4::DOUBLE)
  GROUP BY ALL),
hit0 AS (
  SELECT r.building_id, r.ordinal, r.camera_id, rel, ux, uy, min(t) AS t FROM rays r
  JOIN pose p USING (building_id, ordinal, camera_id) LEFT JOIN local w USING (building_id, ordinal, camera_id),
  LATERAL (SELECT ux * (by - ay) - uy * (bx - ax) AS den),
  LATERAL (SELECT CASE WHEN abs(den) >= 1e-12 THEN ((ax - cx) * (by - ay) - (ay - cy) * (bx - ax)) / den END AS t0,
    CASE WHEN abs(den) >= 1e-12 THEN ((ax - cx) * uy - (ay - cy) * ux) / den END AS u),
  LATERAL (SELECT CASE WHEN t0 >= 0 AND u >= 0 AND u <= 1 THEN t0 END AS t)
  GROUP BY ALL),
hits AS MATERIALIZED (
  SELECT h.*, least(coalesce(t, r), r) AS dist, row_number() OVER (PARTITION BY building_id, ordinal, camera_id ORDER BY rel) AS i,
    count(*) OVER (PARTITION BY building_id, ordinal, camera_id) AS n, cx, cy, full_, least(near0, r) AS near
  FROM hit0 h JOIN pose p USING (building_id, ordinal, camera_id)),
verts AS (
  SELECT building_id, ordinal, camera_id, i AS seq, cx + ux * dist AS x, cy + uy * dist AS y FROM hits
  UNION ALL SELECT building_id, ordinal, camera_id, 2 * n + 1 - i, cx + ux * least(near, dist * 0.999::DOUBLE), cy + uy * least(near, dist * 0.999::DOUBLE)
    FROM hits WHERE NOT full_ AND near > 0.3
  UNION ALL SELECT building_id, ordinal, camera_id, 0, cx, cy FROM hits WHERE NOT full_ AND near <= 0.3 AND i = 1),
redges AS MATERIALIZED (
  SELECT building_id, ordinal, camera_id, x AS ax, y AS ay,
    coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by
  FROM verts WINDOW w AS (PARTITION BY building_id, ordinal, camera_id ORDER BY seq))
"""


def seen(points: str, pid: str) -> str:
    """CTE `seen`: every (point, camera) with its score; points need px, py."""
    return f"""
cand AS (
  SELECT q.building_id, q.ordinal, q.{pid}, p.camera_id, p.pos AS cam_pos, px, py, rng, d AS distance_m,
    CASE WHEN full_ THEN 0.62::DOUBLE ELSE 1 - least(off / greatest(half, 1e-6), 1) END AS align
  FROM {points} q JOIN pose p USING (building_id, ordinal),
  LATERAL (SELECT sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) AS d,
    abs({wrap('(atan2(py - cy, px - cx) - radians(heading))')}) AS off)
  WHERE d <= rng + 1e-6 AND (full_ OR off <= half + 3e-4)),
seen AS MATERIALIZED (
  SELECT *, align * 0.45::DOUBLE + (1 - least(distance_m / greatest(rng, 1e-6), 1)) * 0.35::DOUBLE + least(depth_m / 6, 1) * 0.2::DOUBLE AS score
  FROM (
    SELECT c.building_id, c.ordinal, c.{pid}, c.camera_id, any_value(cam_pos) AS cam_pos, any_value(distance_m) AS distance_m,
      any_value(align) AS align, any_value(rng) AS rng,
      sum(CASE WHEN (ay > py) <> (by > py) AND px < (bx - ax) * (py - ay) / nullif(by - ay, 0) + ax THEN 1 ELSE 0 END) % 2 AS odd,
      min(sqrt((px - (ax + t * (bx - ax))) * (px - (ax + t * (bx - ax))) + (py - (ay + t * (by - ay))) * (py - (ay + t * (by - ay))))) AS depth_m
    FROM cand c JOIN redges e USING (building_id, ordinal, camera_id),
    LATERAL (SELECT coalesce(least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0), 0), 1), 0) AS t)
    GROUP BY c.building_id, c.ordinal, c.{pid}, c.camera_id)
  WHERE odd = 1)
"""


def sql(body: str, *blocks: str) -> str:
    text = "WITH RECURSIVE " + ",\n".join(b.strip() for b in (SCENE, *blocks)) + "\n" + body
    # Lower-case `by` is a coordinate here, not the keyword.
    return re.sub(r"\bby\b", "b_y", text)
