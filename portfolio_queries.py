"""Every registered query: a Spark callable and, where SQL can say it, its
DuckDB counterpart. Doubles are rounded to three decimals on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

import portfolio_oracle as o
from floorlens.functions import geometry as g, labels, optics
from floorlens.operators import coverage as cov, index as idx, places, probe, quality, regions, search, visitor
from floorlens.operators.spatial import FLOOR, number_rows
from floorlens.operators.visibility import visibility
from floorlens.operators.walls import walls
from floorlens.plans import directions, navgraph, routes, suggest
from floorlens.session import cut, shared_folder, stored
from floorlens.sources import catalogue
from floorlens.sources.scene import Scene

QUERIES: dict = {}
ORACLE: dict = {}
#: Camera suggestions: points of a floor to be seen, and cameras to add at most.
TARGET_PCT, MOST_NEW = 70.0, 9


class Portfolio:
    """The scene's tables as an analyst would hold them: derived from the
    given tables once per session, written, and read back by every query."""

    def __init__(self, spark, sf_dir):
        self._scene, self._tables = Scene(spark, sf_dir), {}

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = stored(self._derive(name), name)
        return self._tables[name]

    def _derive(self, name):
        if name == "wall_segments":
            return walls(self.units, self.footprints, self.structures)
        if name == "rings":
            return visibility(self.cameras, self.wall_segments)
        if name == "found_routes":
            return routes.routes(self.routes, self.units, self.openings, self.verticals)
        if name == "suggested":
            return suggest.suggest(self.units, self.footprints, self.cameras, self.wall_segments, self.rings, TARGET_PCT, MOST_NEW)
        return getattr(self._scene, name)


_PORTFOLIOS: dict = {}


def portfolio(spark, sf_dir) -> Portfolio:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PORTFOLIOS:
        _PORTFOLIOS[key] = Portfolio(spark, sf_dir)
    return _PORTFOLIOS[key]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(portfolio(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r3(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 3)
    return out.alias(name) if name else out


def scene_walls(s: Portfolio) -> DataFrame:
    return s.wall_segments


def scene_rings(s: Portfolio) -> DataFrame:
    return s.rings


# -- walls, visibility, probes --------------------------------------------


@query("walls", o.sql("SELECT building_id, ordinal, source, source_id, CAST(pos AS INTEGER) AS pos, ax AS x1, ay AS y1, bx AS x2, by AS y2 FROM walls", o.WALLS))
def _(s):
    return walls(s.units, s.footprints, s.structures).select(
        *FLOOR, "source", "source_id", "pos", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"),
        F.col("b.x").alias("x2"), F.col("b.y").alias("y2"),
    )


@query("visibility", o.sql(
    """SELECT building_id, ordinal, camera_id, count(*) AS vertices, round(abs(sum(ax * by - bx * ay)) / 2, 2) AS area_m2,
    round(min(ax), 3) AS x0, round(min(ay), 3) AS y0, round(max(ax), 3) AS x1, round(max(ay), 3) AS y1
    FROM redges GROUP BY ALL""", o.WALLS, o.RINGS))
def _(s):
    b = g.bbox(F.col("ring"))
    return visibility(s.cameras, s.wall_segments).select(
        "building_id", "ordinal", "camera_id", F.size("ring").cast("bigint").alias("vertices"),
        F.round(g.polygon_area(F.col("ring")), 2).alias("area_m2"),
        *[r3(b[k], k) for k in ("x0", "y0", "x1", "y1")],
    )


@query("probe_ranking", o.sql(
    """SELECT building_id, ordinal, probe_id, camera_id, round(score, 3) AS score, round(distance_m, 3) AS distance_m,
    round(depth_m, 4) AS depth_m, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, cam_pos) AS rank FROM seen)""",
    o.WALLS, o.RINGS, o.seen("probes", "probe_id")))
def _(s):
    return probe.rank_cameras(s.probes, s.cameras, scene_rings(s)).select(
        *FLOOR, "probe_id", "camera_id", r3("score"), r3("distance_m"), F.round("depth_m", 4), "rank"
    ).toDF(*FLOOR, "probe_id", "camera_id", "score", "distance_m", "depth_m", "rank")


@query("probe_page", o.sql(
    """SELECT building_id, ordinal, probe_id, camera_id, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, cam_pos) AS INTEGER) AS rank FROM seen)
    WHERE rank <= 16""", o.WALLS, o.RINGS, o.seen("probes", "probe_id")))
def _(s):
    page = probe.rank_cameras(s.probes, s.cameras, scene_rings(s), top=16)
    return page.select(*FLOOR, "probe_id", "camera_id", "rank")


@query("blind_probes", o.sql(
    "SELECT building_id, ordinal, probe_id FROM probes p WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.probe_id = p.probe_id)",
    o.WALLS, o.RINGS, o.seen("probes", "probe_id")))
def _(s):
    seen = probe.see(s.probes, s.cameras, scene_rings(s)).select("probe_id")
    return s.probes.select(*FLOOR, "probe_id").join(seen, "probe_id", "left_anti").select(*FLOOR, "probe_id")


@query("incident_cameras", o.sql(
    """SELECT i.building_id, i.ordinal, i.incident_id, i.kind, count(s.camera_id) AS cameras,
    arg_min(s.camera_id, (-s.score, s.cam_pos)) AS best_camera, arg_min(u.unit_id, ((u.x1-u.x0)*(u.y1-u.y0), u.pos)) AS unit_id
    FROM incidents i LEFT JOIN seen s USING (probe_id) LEFT JOIN units u ON u.building_id = i.building_id AND u.ordinal = i.ordinal
      AND i.px >= u.x0 AND i.px < u.x1 AND i.py >= u.y0 AND i.py < u.y1
    GROUP BY ALL""".replace("count(s.camera_id)", "count(DISTINCT s.camera_id)"),
    o.WALLS, o.RINGS, o.seen("incidents", "probe_id")))
def _(s):
    seen = (
        probe.see(s.incidents, s.cameras, scene_rings(s), "incident_id")
        .groupBy(*FLOOR, "incident_id")
        .agg(
            F.count("*").alias("cameras"),
            F.min_by("camera_id", F.struct(-F.col("score"), F.col("cam_pos"))).alias("best_camera"),
        )
    )
    place = places.smallest_unit(s.incidents.select(*FLOOR, "incident_id", "at"), s.units, "incident_id")
    return (
        s.incidents.select(*FLOOR, "incident_id", "kind")
        .join(seen, [*FLOOR, "incident_id"], "left")
        .join(place, [*FLOOR, "incident_id"], "left")
        .fillna(0, ["cameras"])
    )


# -- coverage --------------------------------------------------------------

SCAN = """
rows_ AS (SELECT building_id, ordinal, camera_id, ax, ay, bx, by,
  unnest(range(CAST(ceil(least(ay, by) / 0.25 - 0.5) AS BIGINT), CAST(ceil(greatest(ay, by) / 0.25 - 0.5) AS BIGINT))) AS line
  FROM redges WHERE ay <> by),
cross_ AS (SELECT building_id, ordinal, camera_id, line, (bx - ax) * ((line + 0.5::DOUBLE) * 0.25::DOUBLE - ay) / (by - ay) + ax AS x FROM rows_
  WHERE line BETWEEN 0 AND 51),
iv AS (SELECT * FROM (SELECT building_id, ordinal, line, x AS x1, lead(x) OVER w AS x2, row_number() OVER w AS n FROM cross_
  WINDOW w AS (PARTITION BY building_id, ordinal, camera_id, line ORDER BY x)) WHERE n % 2 = 1 AND x2 > x1),
clip AS (SELECT building_id, ordinal, line, greatest(x1, 0) AS x1, least(x2, 60) AS x2 FROM iv WHERE x2 > 0 AND x1 < 60),
merged AS (SELECT *, coalesce(max(x2) OVER (PARTITION BY building_id, ordinal, line ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS prev FROM clip),
covered AS (SELECT building_id, ordinal, sum(greatest(0, x2 - greatest(x1, prev))) * 0.25 AS m2 FROM merged GROUP BY ALL)
"""


@query("coverage", o.sql(
    """SELECT f.building_id, f.ordinal, 780.0::DOUBLE AS floor_m2, round(coalesce(m2, 0), 2) AS covered_m2,
    round(780 - coalesce(m2, 0), 2) AS blind_m2, round(coalesce(m2, 0) / 780, 3) AS coverage_pct
    FROM floors f LEFT JOIN covered c USING (building_id, ordinal)""", o.WALLS, o.RINGS, SCAN))
def _(s):
    return cov.coverage(s.units, s.footprints, scene_rings(s)).select(
        *FLOOR, F.round("floor_m2", 2).alias("floor_m2"), F.round("covered_m2", 2).alias("covered_m2"),
        F.round("blind_m2", 2).alias("blind_m2"), r3("coverage_pct", "coverage_pct"),
    )


CELLS = """
cells AS (SELECT building_id, ordinal, i * 11 + j AS cell, 0.625::DOUBLE + i * 1.25::DOUBLE AS px, 0.625::DOUBLE + j * 1.25::DOUBLE AS py
  FROM floors, range(48) a(i), range(11) b(j) WHERE 0.625 + i * 1.25 < 60 AND 0.625 + j * 1.25 < 13)
"""


@query("grid_coverage", o.sql(
    """SELECT c.building_id, c.ordinal, count(*) AS cells, count(*) FILTER (n > 0) AS covered, count(*) FILTER (n > 1) AS redundant
    FROM (SELECT c.*, coalesce(n, 0) AS n FROM cells c LEFT JOIN (
      SELECT building_id, ordinal, cell, count(*) AS n FROM seen GROUP BY ALL) s USING (building_id, ordinal, cell)) c
    GROUP BY ALL""", o.WALLS, o.RINGS, CELLS, o.seen("cells", "cell")))
def _(s):
    return cov.grid_coverage(s.units, s.footprints, scene_rings(s))


REGIONS = """
clip0 AS (SELECT *, coalesce(max(x2) OVER (PARTITION BY building_id, ordinal, line ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS upto FROM clip),
clip1 AS (SELECT *, sum(CASE WHEN x1 > upto + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY building_id, ordinal, line ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS n FROM clip0),
crun AS (SELECT building_id, ordinal, line, min(x1) AS x1, max(x2) AS x2 FROM clip1 GROUP BY building_id, ordinal, line, n HAVING max(x2) - min(x1) > 1e-6),
edge0 AS (SELECT building_id, ordinal, line, x1, x2 FROM crun
  UNION ALL SELECT building_id, ordinal, line, -1::DOUBLE, 0::DOUBLE FROM floors, range(52) t(line)
  UNION ALL SELECT building_id, ordinal, line, 60::DOUBLE, 61::DOUBLE FROM floors, range(52) t(line)),
gap AS (SELECT building_id, ordinal, line, x2 AS x1, lead(x1) OVER (PARTITION BY building_id, ordinal, line ORDER BY x1, x2) AS x2 FROM edge0),
run AS (SELECT 'covered' AS kind, * FROM crun UNION ALL SELECT 'blind', * FROM gap WHERE x2 - x1 > 1e-6),
runs_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kind, building_id, ordinal, line, x1) AS id, * FROM run),
touch AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.kind, a.building_id, a.ordinal FROM runs_ a
  JOIN runs_ b ON a.kind = b.kind AND a.building_id = b.building_id AND a.ordinal = b.ordinal AND b.line = a.line + 1
  WHERE a.x1 < b.x2 AND b.x1 < a.x2),
both_ AS MATERIALIZED (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch),
lab(id, low) USING KEY (id) AS (
  SELECT id, id FROM runs_
  UNION
  SELECT u.id, min(v.low) FROM recurring.lab u, both_ e, lab v WHERE e.a = u.id AND e.b = v.id AND v.low < u.low GROUP BY u.id),
labelled AS (SELECT r.*, low FROM runs_ r JOIN lab USING (id))
"""


@query("blind_regions", o.sql(
    """SELECT building_id, ordinal, round(sum(x2 - x1) * 0.25, 3) AS area_m2, round(min(x1), 3) AS x0, min(line) * 0.25::DOUBLE AS y0,
    round(max(x2), 3) AS x1, (max(line) + 1) * 0.25::DOUBLE AS y1 FROM labelled WHERE kind = 'blind' GROUP BY building_id, ordinal, low""",
    o.WALLS, o.RINGS, SCAN, REGIONS))
def _(s):
    return regions.blind_regions(s.units, s.footprints, scene_rings(s)).select(
        *FLOOR, r3("area_m2", "area_m2"), r3("x0", "x0"), "y0", r3("x1", "x1"), "y1"
    )


# A region of runs has as many holes as links between its runs beyond those
# that a tree needs, so rings can be counted without drawing any.
@query("coverage_outlines", o.sql(
    """SELECT kind, building_id, ordinal, regions AS outlines, coalesce(links, 0) - runs + regions AS holes, area_m2 FROM (
      SELECT kind, building_id, ordinal, count(*) AS runs, count(DISTINCT low) AS regions, round(sum(x2 - x1) * 0.25, 2) AS area_m2
      FROM labelled GROUP BY ALL)
    LEFT JOIN (SELECT kind, building_id, ordinal, count(*) AS links FROM touch GROUP BY ALL) USING (kind, building_id, ordinal)""",
    o.WALLS, o.RINGS, SCAN, REGIONS))
def _(s):
    rings = regions.outlines(s.units, s.footprints, scene_rings(s))
    area = g.polygon_area(F.col("ring"))
    return rings.groupBy("kind", *FLOOR).agg(
        F.count_if(~F.col("hole")).alias("outlines"), F.count_if("hole").alias("holes"),
        F.round(F.sum(F.when(F.col("hole"), -area).otherwise(area)), 2).alias("area_m2"),
    )


# -- camera suggestions ----------------------------------------------------

# Mounts of rectangles: one for rooms of 30 m2, two for the hall.
MOUNTS = """
hold AS (SELECT u.building_id, u.unit_id FROM units u JOIN cameras c ON c.building_id = u.building_id AND c.ordinal = u.ordinal
  AND cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1),
mount0 AS (
  SELECT u.*, i, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, CASE WHEN i = 0 THEN x0 ELSE x1 END AS vx, CASE WHEN i = 0 THEN y0 ELSE y1 END AS vy,
    least(greatest(floor(1.7::DOUBLE * sqrt((x1 - x0) * (y1 - y0)) + 0.5), 16), 50) AS rng
  FROM units u, range(2) t(i)
  WHERE category NOT IN ('stairs','elevator','outside') AND (x1 - x0) * (y1 - y0) >= 25 AND (i = 0 OR (x1 - x0) * (y1 - y0) >= 120)
    AND (building_id, unit_id) NOT IN (SELECT (building_id, unit_id) FROM hold)),
mount1 AS (
  SELECT *, vx + (mx - vx) / d * 1.3::DOUBLE AS rx, vy + (my - vy) / d * 1.3::DOUBLE AS ry
  FROM mount0, LATERAL (SELECT sqrt((mx - vx) * (mx - vx) + (my - vy) * (my - vy)) AS d)),
mount2 AS (SELECT *, degrees(atan2(my - ry, mx - rx)) AS rh FROM mount1),
mounts AS (
  SELECT m.building_id, m.ordinal, unit_id || '/' || i AS camera_id, pos * 8 + i AS pos, floor(rx * 10 + 0.5) / 10 AS cx, floor(ry * 10 + 0.5) / 10 AS cy,
    (floor(rh + 360 + 0.5) % 360)::DOUBLE AS heading, 100::DOUBLE AS fov, rng, 'fixed' AS kind, name, NULL::DOUBLE AS tilt, NULL::DOUBLE AS mount, rx, ry, rh
  FROM mount2 m WHERE NOT EXISTS (SELECT 1 FROM cameras c WHERE c.building_id = m.building_id AND c.ordinal = m.ordinal
    AND sqrt((cx - rx) * (cx - rx) + (cy - ry) * (cy - ry)) <= 1.5
    AND least(abs(c.heading - rh) % 360, 360 - abs(c.heading - rh) % 360) <= 25))
"""


@query("corner_mounts", o.sql(
    """SELECT building_id, ordinal, camera_id AS candidate_id, CAST(row_number() OVER (PARTITION BY building_id, ordinal ORDER BY pos) AS INTEGER) AS seq,
    name AS zone, round(cx, 3) AS x, round(cy, 3) AS y, heading, rng AS range_m, m2 AS seen_m2
    FROM mounts JOIN (SELECT building_id, ordinal, camera_id, round(abs(sum(ax * by - bx * ay)) / 2, 2) AS m2 FROM redges GROUP BY ALL) USING (building_id, ordinal, camera_id)
    WHERE m2 >= 15 QUALIFY row_number() OVER (PARTITION BY building_id, ordinal ORDER BY pos) <= 6""",
    o.WALLS, MOUNTS, o.RINGS.replace("FROM cameras)", "FROM mounts)")))
def _(s):
    return suggest.corner_mounts(s.units, s.cameras, s.wall_segments, 6).select(
        *FLOOR, "candidate_id", "seq", "zone", r3("at.x", "x"), r3("at.y", "y"), "heading", "range_m", F.round(g.polygon_area(F.col("ring")), 2).alias("seen_m2")
    )


@query("suggested_cameras")
def _(s):
    return s.suggested.select(*FLOOR, "seq", "way", "name", r3("at.x", "x"), r3("at.y", "y"), "heading", "fov_deg", "range_m", "gain")


@query("suggestion_gain")
def _(s):
    return suggest.gain(s.units, s.footprints, scene_rings(s), s.suggested).select(*FLOOR, r3("before_pct"), r3("after_pct"), "corner_count", "fill_count").toDF(
        *FLOOR, "before_pct", "after_pct", "corner_count", "fill_count")


# -- camera index ----------------------------------------------------------

# Rooms of 6 x 5 m catch no point of the 8 m sample grid except at (4, 4),
# so every indexable unit here has exactly that one sample.
SAMPLES = """
samples AS (SELECT building_id, ordinal, unit_id, x0 + 4 AS px, y0 + 4 AS py FROM units WHERE category NOT IN ('corridor','outside'))
"""
COUNTS = """
counts AS (SELECT u.building_id, u.ordinal, u.unit_id, u.name, u.category, coalesce(u.security, 'public') AS security,
  count(s.camera_id) AS cameras FROM units u LEFT JOIN seen s USING (building_id, ordinal, unit_id)
  WHERE u.category NOT IN ('corridor','outside') GROUP BY ALL)
"""


@query("camera_index", o.sql(
    """SELECT u.building_id, u.ordinal, u.unit_id, coalesce(u.security, 'public') AS security, s.camera_id,
    round(s.score, 3) AS score, s.rank FROM units u LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY building_id, ordinal, unit_id ORDER BY score DESC, cam_pos) AS rank FROM seen) s
    USING (building_id, ordinal, unit_id) WHERE u.category NOT IN ('corridor','outside')""",
    o.WALLS, o.RINGS, SAMPLES, o.seen("samples", "unit_id")))
def _(s):
    return idx.camera_index(s.units, s.cameras, scene_rings(s)).select(
        *FLOOR, "unit_id", "security", "camera_id", r3("score", "score"), "rank"
    )


@query("index_stats", o.sql(
    """SELECT building_id, count(*) AS spaces, count(*) FILTER (cameras = 0) AS gaps, count(*) FILTER (cameras >= 2) AS redundant,
    count(*) FILTER (security IN ('secure','restricted') AND cameras < 2) AS secure_under_covered FROM counts GROUP BY ALL""",
    o.WALLS, o.RINGS, SAMPLES, o.seen("samples", "unit_id"), COUNTS))
def _(s):
    return idx.index_stats(idx.unit_camera_counts(s.units, s.cameras, scene_rings(s)))


@query("index_gaps", o.sql(
    "SELECT building_id, ordinal, unit_id, name, security, cameras FROM counts WHERE cameras = 0 OR (security IN ('secure','restricted') AND cameras < 2)",
    o.WALLS, o.RINGS, SAMPLES, o.seen("samples", "unit_id"), COUNTS))
def _(s):
    return idx.unit_camera_counts(s.units, s.cameras, scene_rings(s)).where(
        "is_gap or secure_under_covered"
    ).select(*FLOOR, "unit_id", "name", "security", "cameras")


@query("spaces_in_view", o.sql(
    "SELECT building_id, ordinal, camera_id, count(*) AS spaces, round(max(score), 3) AS best FROM seen GROUP BY ALL",
    o.WALLS, o.RINGS, SAMPLES, o.seen("samples", "unit_id")))
def _(s):
    return idx.unit_scores(s.units, s.cameras, scene_rings(s)).groupBy(*FLOOR, "camera_id").agg(
        F.count("*").alias("spaces"), F.round(F.max("score"), 3).alias("best")
    )


@query("camera_unit_overlap")
def _(s):
    return idx.camera_unit_overlap(s.units, scene_rings(s))


# -- optics ----------------------------------------------------------------

PX = "16 * sqrt(mp * 1e6 / 144) / (2 * {d} * tan(CASE WHEN kind = 'dome' OR fov >= 360 THEN 179 ELSE least(greatest(fov, 1), 179) END * 3.141592653589793 / 360))"


@query("dori", o.sql(
    f"""SELECT building_id, ordinal, camera_id, round(coalesce(p1 / 250, 0), 3) AS identify_m, round(coalesce(p1 / 125, 0), 3) AS recognise_m,
    round(coalesce(p1 / 62, 0), 3) AS observe_m, round(coalesce(p1 / 25, 0), 3) AS detect_m, round(coalesce(p1 / rng, 0), 3) AS px_at_range,
    CASE WHEN p1 IS NULL THEN NULL WHEN p1 / rng >= 250 THEN 'identify' WHEN p1 / rng >= 125 THEN 'recognise' WHEN p1 / rng >= 62 THEN 'observe'
      WHEN p1 / rng >= 25 THEN 'detect' ELSE 'below' END AS band_at_range
    FROM (SELECT *, {PX.format(d='1')} AS p1 FROM cameras)"""))
def _(s):
    d = idx.dori(s.cameras)
    return d.select(
        *FLOOR, "camera_id",
        *[r3(c, c) for c in ("identify_m", "recognise_m", "observe_m", "detect_m", "px_at_range")], "band_at_range",
    )


@query("tilt_bands", o.sql(
    """SELECT building_id, camera_id, round(near0, 3) AS near_m, CASE WHEN far0 IS NOT NULL THEN round(greatest(near0, far0), 3) END AS far_m
    FROM pose2 WHERE banded""", o.WALLS, o.RINGS))
def _(s):
    band = optics.tilt_band(
        F.col("kind"), F.col("fov_deg"), F.col("tilt_deg"), F.col("mount_m"), F.col("vfov_deg")
    )
    far = F.when(F.col("band.far_m") < float("inf"), F.col("band.far_m"))
    return s.cameras.withColumn("band", band).where("band is not null").select(
        "building_id", "camera_id", r3("band.near_m", "near_m"), r3(far, "far_m")
    )


@query("ptz_steps", o.sql(
    """SELECT camera_id, (heading + 5) % 360 AS pan_right, (heading + 355) % 360 AS pan_left,
    round(greatest(fov / 1.25, 20), 3) AS zoom_in_fov, round(rng * sqrt(fov / greatest(fov / 1.25, 20)), 3) AS zoom_in_range,
    least(greatest(coalesce(tilt, 35) + 5, 12), 80)::DOUBLE AS tilt_down FROM cameras WHERE kind = 'ptz'"""))
def _(s):
    z = optics.zoom_step(F.col("fov_deg"), F.col("range_m"), F.lit(1))
    return s.cameras.where("kind = 'ptz'").select(
        "camera_id",
        optics.pan_step(F.col("heading"), F.lit(1)).alias("pan_right"),
        optics.pan_step(F.col("heading"), F.lit(-1)).alias("pan_left"),
        r3(z["fov_deg"], "zoom_in_fov"), r3(z["range_m"], "zoom_in_range"),
        optics.tilt_step(F.col("tilt_deg"), F.lit(1)).alias("tilt_down"),
    )


# -- places ----------------------------------------------------------------


@query("unit_geometry", o.sql(
    """SELECT building_id, unit_id, (x1 - x0) * (y1 - y0) AS area_m2, 2 * ((x1 - x0) + (y1 - y0)) AS perimeter_m,
    round((x0 + x1) / 2, 3) AS cx, round((y0 + y1) / 2, 3) AS cy, round(lng0 + (x0 + x1) / 2 / (111320 * cos(radians(lat0))), 6) AS lng,
    round(lat0 + (y0 + y1) / 2 / 111320, 6) AS lat, printf('%.1f ft', 2 * ((x1 - x0) + (y1 - y0)) * 3.280839895) AS perimeter_text
    FROM units JOIN buildings USING (building_id)"""))
def _(s):
    c = F.col("c")
    ll = g.m2ll(F.col("origin_lng"), F.col("origin_lat"), c)
    per = g.polygon_perimeter(F.col("polygon"))
    return s.units.join(s.buildings, "building_id").withColumn("c", g.polygon_centroid(F.col("polygon"))).select(
        "building_id", "unit_id", g.polygon_area(F.col("polygon")).alias("area_m2"), per.alias("perimeter_m"),
        r3(c["x"], "cx"), r3(c["y"], "cy"), F.round(ll[0], 6).alias("lng"), F.round(ll[1], 6).alias("lat"),
        labels.format_length(per, "ft").alias("perimeter_text"),
    )


INSIDE = "u.building_id = p.building_id AND u.ordinal = p.ordinal AND p.px >= u.x0 AND p.px < u.x1 AND p.py >= u.y0 AND p.py < u.y1"


@query("smallest_unit", o.sql(
    f"SELECT p.building_id, p.ordinal, p.probe_id, arg_min(u.unit_id, ((u.x1-u.x0)*(u.y1-u.y0), u.pos)) AS unit_id FROM probes p JOIN units u ON {INSIDE} GROUP BY ALL"))
def _(s):
    return places.smallest_unit(s.probes.select(*FLOOR, "probe_id", "at"), s.units, "probe_id")


@query("first_unit", o.sql(
    f"SELECT p.building_id, p.ordinal, p.probe_id, arg_min(u.unit_id, u.pos) AS unit_id FROM probes p JOIN units u ON {INSIDE} GROUP BY ALL"))
def _(s):
    return places.first_unit(s.probes.select(*FLOOR, "probe_id", "at"), s.units, "probe_id")


@query("occupant_names", o.sql("SELECT building_id, unit_id, string_agg(name, ' ' ORDER BY pos, name) AS names FROM occupants GROUP BY ALL"))
def _(s):
    return places.occupant_names(s.occupants)


@query("occupant_anchors", o.sql(
    """SELECT o.building_id, o.occupant_id, coalesce(ax, (x0 + x1) / 2) AS x, coalesce(ay, (y0 + y1) / 2) AS y
    FROM occupants o JOIN units u USING (building_id, unit_id)"""))
def _(s):
    return places.occupant_anchors(s.occupants, s.units).select(
        "building_id", "occupant_id", r3("at.x", "x"), r3("at.y", "y")
    )


@query("vacant_units", o.sql(
    f"SELECT building_id, unit_id, name, category FROM units u WHERE {o.SPACE} AND NOT EXISTS (SELECT 1 FROM occupants x WHERE x.building_id = u.building_id AND x.unit_id = u.unit_id)"))
def _(s):
    return places.vacant_units(s.units, s.occupants).select("building_id", "unit_id", "name", "category")


@query("auto_doors", o.sql(
    f"""SELECT u.building_id, u.ordinal, u.unit_id, least(greatest((x0 + x1) / 2, 0), 60) AS x, CASE WHEN y1 <= 5 THEN 5.0::DOUBLE WHEN y0 >= 8 THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END AS y
    FROM units u WHERE {o.SPACE} AND NOT EXISTS (SELECT 1 FROM openings x WHERE x.building_id = u.building_id AND x.unit_id = u.unit_id)"""))
def _(s):
    return places.auto_doors(s.units, s.openings).select(*FLOOR, "unit_id", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


@query("door_adjacency", o.sql(
    """SELECT o.building_id, o.opening_id, o.unit_id AS owner, CASE WHEN o.kind = 'entrance' THEN NULL ELSE 'c' || u.building_id || '-' || u.ordinal END AS other
    FROM openings o JOIN units u USING (building_id, unit_id)"""))
def _(s):
    return places.door_adjacency(s.openings, s.units).select("building_id", "opening_id", "owner", "other")


@query("badge_readers", o.sql(
    "SELECT o.building_id, u.ordinal, o.opening_id, u.security, o.ox AS x, o.oy AS y FROM openings o JOIN units u USING (building_id, unit_id) WHERE security IN ('secure','restricted')"))
def _(s):
    return places.badge_readers(s.openings, s.units).select(
        *FLOOR, "opening_id", "security", F.col("at.x").alias("x"), F.col("at.y").alias("y")
    )


@query("snap_points", o.sql(
    """SELECT probe_id, round(CASE WHEN dv <= 0.5 THEN vx WHEN de <= 0.5 THEN ex ELSE floor(px + 0.5) END, 3) AS x,
    round(CASE WHEN dv <= 0.5 THEN vy WHEN de <= 0.5 THEN ey ELSE floor(py + 0.5) END, 3) AS y,
    CASE WHEN dv <= 0.5 THEN 'vertex' WHEN de <= 0.5 THEN 'edge' ELSE 'grid' END AS snap_kind FROM (
      SELECT p.probe_id, any_value(px) AS px, any_value(py) AS py, min(dv) AS dv, arg_min(w.ax, (dv, u.pos, w.pos)) AS vx, arg_min(w.ay, (dv, u.pos, w.pos)) AS vy,
        min(de) AS de, arg_min(fx, (de, u.pos, w.pos)) AS ex, arg_min(fy, (de, u.pos, w.pos)) AS ey
      FROM probes p JOIN walls w USING (building_id, ordinal) JOIN units u ON u.building_id = w.building_id AND u.unit_id = w.source_id,
      LATERAL (SELECT least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)), 0), 1) AS t),
      LATERAL (SELECT ax + t * (bx - ax) AS fx, ay + t * (by - ay) AS fy),
      LATERAL (SELECT sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay)) AS dv, sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)) AS de)
      WHERE w.source = 'unit' GROUP BY p.probe_id)""", o.WALLS))
def _(s):
    return places.snap_points(s.probes, s.units, 0.5, "probe_id", grid=1.0).select(
        "probe_id", r3("snapped.x", "x"), r3("snapped.y", "y"), "snap_kind"
    )


@query("nearest_cameras", o.sql(
    """SELECT building_id, ordinal, probe_id, camera_id, round(d, 3) AS distance_m, rank FROM (
      SELECT p.building_id, p.ordinal, probe_id, camera_id, sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy)) AS d,
        CAST(row_number() OVER (PARTITION BY probe_id ORDER BY (px-cx)*(px-cx)+(py-cy)*(py-cy), c.pos) AS INTEGER) AS rank
      FROM probes p JOIN cameras c USING (building_id, ordinal)) WHERE rank <= 8"""))
def _(s):
    return places.nearest_cameras(s.probes, s.cameras, "probe_id").select(
        *FLOOR, "probe_id", "camera_id", r3("distance_m", "distance_m"), "rank"
    )


@query("view_cameras", o.sql(
    """SELECT v.building_id, v.ordinal, v.view_id, v.camera_id, CAST(v.seq AS INTEGER) AS seq FROM (
      SELECT c.building_id, c.ordinal, 'v' || pos AS view_id, 'cam' || (pos + nb * [3,0,1,6][i + 1]) AS camera_id, i AS seq
      FROM cameras c, nbt, range(4) t(i) WHERE pos % 10 = 0) v
    JOIN cameras c USING (building_id, ordinal, camera_id)"""))
def _(s):
    return places.live_view_cameras(s.camera_views, s.cameras).select(*FLOOR, "view_id", "camera_id", "seq")


CAMSPACE = """
camspace AS (SELECT c.building_id, c.ordinal, c.camera_id, arg_min(u.unit_id, ((u.x1-u.x0)*(u.y1-u.y0), u.pos)) AS unit_id
  FROM cameras c JOIN units u ON u.building_id = c.building_id AND u.ordinal = c.ordinal AND cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1 GROUP BY ALL)
"""


# Views of a building stand on every floor of it, with the cameras there.
VIEWS = """
views AS (SELECT building_id, pos, 'v' || pos AS view_id, 'View ' || pos AS name, [pos + nb * 3, pos, pos + nb, pos + nb * 6] AS held FROM cameras, nbt WHERE pos % 10 = 0),
saved AS (SELECT l.building_id, l.ordinal, v.pos, view_id, v.name, count(c.camera_id) AS n FROM levels l JOIN views v USING (building_id), unnest(held) t(k)
  LEFT JOIN cameras c ON c.building_id = l.building_id AND c.ordinal = l.ordinal AND c.pos = k GROUP BY ALL)
"""


@query("camera_walls", o.sql(
    """SELECT building_id, ordinal, CAST(row_number() OVER (PARTITION BY building_id, ordinal ORDER BY kind, size, pos, name, wall_id) AS INTEGER) AS place,
    ['all', 'room', 'saved'][kind + 1] AS wall_kind, wall_id, name, cameras FROM (
      SELECT l.building_id, l.ordinal, 0 AS kind, 0 AS size, 0 AS pos, 'all' AS wall_id, 'All · ' || l.name AS name, count(camera_id) AS cameras
        FROM levels l LEFT JOIN cameras c USING (building_id, ordinal) GROUP BY ALL
      UNION ALL SELECT s.building_id, s.ordinal, 1, -count(*), 0, 'room:' || unit_id, u.name, count(*) FROM camspace s JOIN units u USING (building_id, unit_id)
        GROUP BY s.building_id, s.ordinal, unit_id, u.name
      UNION ALL SELECT building_id, ordinal, 2, 0, pos, 'saved:' || view_id, name, n FROM saved)""", CAMSPACE, VIEWS))
def _(s):
    return places.camera_rail(s.cameras, s.units, s.levels, s.camera_views)


@query("units_without_camera", o.sql(
    """SELECT building_id, unit_id FROM units u WHERE NOT EXISTS (SELECT 1 FROM cameras c WHERE c.building_id = u.building_id
    AND c.ordinal = u.ordinal AND cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1)"""))
def _(s):
    return places.units_without_camera(s.units, s.cameras).select("building_id", "unit_id")


@query("duplicate_cameras", o.sql(
    """SELECT DISTINCT a.building_id, a.ordinal, a.camera_id AS candidate_id
    FROM (SELECT *, cx + pos % 4 * 0.6 AS x, heading + pos % 3 * 20 AS h FROM cameras) a JOIN cameras b USING (building_id, ordinal)
    WHERE sqrt((a.x-b.cx)*(a.x-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)) <= 1.5
    AND least((a.h - b.heading + 720) % 360, (b.heading - a.h + 720) % 360) <= 25"""))
def _(s):
    # Every camera once more, moved by up to 1.8 m and turned by up to 40 degrees.
    moved = g.pt(F.col("at.x") + F.col("pos") % 4 * 0.6, F.col("at.y"))
    turned = F.col("heading") + F.col("pos") % 3 * 20
    again = s.cameras.select(*FLOOR, F.col("camera_id").alias("candidate_id"), moved.alias("at"), turned.alias("heading"))
    return places.duplicate_cameras(again, s.cameras).select(*FLOOR, "candidate_id").distinct()


@query("search_spaces", o.sql(
    """SELECT u.building_id, u.unit_id, u.name FROM units u LEFT JOIN (
      SELECT building_id, unit_id, string_agg(name, ' ' ORDER BY pos) AS names FROM occupants GROUP BY ALL) n USING (building_id, unit_id)
    WHERE category NOT IN ('corridor','elevator','stairs') AND (lower(u.name) LIKE '%ring%' OR category LIKE '%ring%' OR lower(coalesce(names, '')) LIKE '%ring%')"""))
def _(s):
    return search.spaces(s.units, s.occupants, " Ring ").select("building_id", "unit_id", "name")


@query("search_cameras", o.sql(
    """SELECT building_id, ordinal, camera_id, count(*) OVER (PARTITION BY building_id) AS matches FROM cameras WHERE kind = 'ptz' AND lower(name) LIKE '%1%'
    QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY pos) <= 200"""))
def _(s):
    return search.cameras(s.cameras, "1", "ptz", top=200).select(*FLOOR, "camera_id", "matches")


@query("search_amenities", o.sql(
    """SELECT amenity_id, kind FROM amenities WHERE lower(coalesce(name, '')) LIKE '%bar%' OR kind LIKE '%bar%'"""))
def _(s):
    return search.amenities(s.amenities, "bar").select("amenity_id", "kind")


@query("addable_cameras", o.sql(
    """SELECT building_id, ordinal, camera_id, count(*) OVER (PARTITION BY building_id, ordinal) AS matches FROM cameras c
    WHERE (lower(name) LIKE '%9%' OR coalesce(CAST(op_number AS VARCHAR), '') LIKE '9%')
    AND NOT EXISTS (SELECT 1 FROM (SELECT v.building_id, 'cam' || (v.pos + nb * f) AS camera_id FROM cameras v, nbt, (VALUES (3),(0),(1),(6)) t(f) WHERE v.pos % 10 = 0) x
      WHERE x.building_id = c.building_id AND x.camera_id = c.camera_id)"""))
def _(s):
    return search.addable_cameras(s.cameras, s.camera_views, "9").select(*FLOOR, "camera_id", "matches")


@query("amenity_kinds", o.sql("SELECT DISTINCT building_id, kind FROM amenities"))
def _(s):
    return search.amenity_kinds(s.amenities)


@query("tenant_directory", o.sql(
    """SELECT building_id, category, count(*) AS tenants, count(DISTINCT unit_id) AS units FROM occupants GROUP BY ALL
    UNION ALL SELECT building_id, 'vacant', 0, count(*) FROM units u WHERE category NOT IN ('corridor','elevator','stairs','outside')
      AND NOT EXISTS (SELECT 1 FROM occupants x WHERE x.building_id = u.building_id AND x.unit_id = u.unit_id) GROUP BY ALL"""))
def _(s):
    return search.directory(s.occupants, s.units)


@query("lit_cameras", o.sql(
    """SELECT building_id, ordinal, probe_id, camera_id, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY rank) AS INTEGER) AS place FROM (
      SELECT building_id, ordinal, probe_id, camera_id, min(rank) AS rank FROM (
        SELECT p.building_id, p.ordinal, probe_id, camera_id, row_number() OVER (PARTITION BY probe_id ORDER BY (px-cx)*(px-cx)+(py-cy)*(py-cy), c.pos) AS rank
          FROM probes p JOIN cameras c USING (building_id, ordinal) QUALIFY rank <= 8
        UNION ALL SELECT p.building_id, p.ordinal, probe_id, c.camera_id, 0 FROM probes p JOIN (
          SELECT building_id, ordinal, max_by(camera_id, pos) AS camera_id FROM cameras GROUP BY ALL) c USING (building_id, ordinal))
      GROUP BY ALL) QUALIFY place <= 9"""))
def _(s):
    last = s.cameras.groupBy(*FLOOR).agg(F.max_by("camera_id", "pos").alias("camera_id"))
    selected = s.probes.select(*FLOOR, "probe_id").join(last, FLOOR)
    return search.lit_cameras(places.nearest_cameras(s.probes, s.cameras, "probe_id"), "probe_id", selected).select(*FLOOR, "probe_id", "camera_id", "place")


@query("function_buckets", o.sql(
    """SELECT building_id, CASE WHEN category = 'corridor' THEN 'circ' WHEN category IN ('stairs','elevator') THEN 'core' WHEN category = 'outside' THEN 'outside' ELSE 'gaming' END AS func,
    CASE WHEN category IN ('corridor','lobby') THEN 0.15::DOUBLE WHEN category = 'outside' THEN 0::DOUBLE ELSE coalesce(ceiling_m, 3.2)::DOUBLE END AS height_m, count(*) AS units
    FROM units JOIN levels l USING (building_id, ordinal) GROUP BY ALL"""))
def _(s):
    lv = s.levels.select(*FLOOR, labels.level_ceiling(F.col("ceiling_m")).alias("ceiling"))
    return s.units.join(lv, FLOOR).groupBy(
        "building_id", labels.function_bucket(F.col("unit_id"), F.col("category")).alias("func"),
        labels.unit_height(F.col("category"), F.col("ceiling")).alias("height_m"),
    ).agg(F.count("*").alias("units"))


@query("operator_numbers", o.sql(
    """SELECT building_id, camera_id, CAST(coalesce(op_number, m + row_number() OVER (PARTITION BY building_id, op_number IS NULL ORDER BY pos)) AS BIGINT) AS op_number
    FROM cameras JOIN (SELECT building_id, coalesce(max(op_number), 0) AS m FROM cameras GROUP BY ALL) USING (building_id)"""))
def _(s):
    from floorlens.operators.edits import ensure_numbers

    return ensure_numbers(s.cameras).select("building_id", "camera_id", F.col("op_number").cast("bigint"))


# -- quality ---------------------------------------------------------------

REVIEW = f"""
bare AS (SELECT u.* FROM units u WHERE {o.SPACE} AND NOT EXISTS (SELECT 1 FROM openings x WHERE x.building_id = u.building_id AND x.unit_id = u.unit_id)),
issues AS (
  SELECT building_id, ordinal, 'doorless' AS rule, 'warn' AS severity, (CASE WHEN trim(name) <> '' THEN name ELSE '(blank)' END) || ': no door' AS message, unit_id FROM bare
  UNION ALL SELECT building_id, ordinal, 'unnamed', 'warn', category || ': no name', unit_id FROM units WHERE {o.SPACE} AND trim(name) = ''
  UNION ALL SELECT building_id, ordinal, 'vacant', 'info', (CASE WHEN trim(name) <> '' THEN name ELSE '(blank)' END) || ': no tenant', unit_id FROM units u
    WHERE {o.SPACE} AND NOT EXISTS (SELECT 1 FROM occupants x WHERE x.building_id = u.building_id AND x.unit_id = u.unit_id) AND building_id IN (SELECT building_id FROM occupants))
"""


@query("review", o.sql("SELECT * FROM issues", REVIEW))
def _(s):
    return quality.review(s.units, s.openings, s.verticals, s.occupants).select(*FLOOR, "rule", "severity", "message", "unit_id")


@query("floor_health", o.sql(
    """SELECT f.building_id, f.ordinal, false AS missing_corridor, count(b.unit_id) AS doorless, 0::BIGINT AS one_sided
    FROM floors f LEFT JOIN bare b USING (building_id, ordinal) GROUP BY ALL""", REVIEW))
def _(s):
    return quality.floor_health(s.units, s.openings)


@query("setup_stages", o.sql(
    """SELECT building_id, nl > 1 AS floors, nb_ = 0 AS doors, coalesce(nocc, 0) > 0 AS occupants, nb_ = 0 AS complete, CASE WHEN nb_ > 0 THEN 'doors' END AS active_stage FROM (
      SELECT building_id, (SELECT count(*) FROM floors f WHERE f.building_id = b.building_id) AS nl, (SELECT count(*) FROM bare x WHERE x.building_id = b.building_id) AS nb_,
      (SELECT count(*) FROM occupants x WHERE x.building_id = b.building_id) AS nocc FROM buildings b)""", REVIEW))
def _(s):
    return quality.setup_stages(s.buildings, s.units, s.openings, s.verticals, s.occupants, s.levels).select(
        "building_id", "floors", "doors", "occupants", "complete", "active_stage"
    )


@query("floor_program", o.sql(
    """SELECT building_id, ordinal, bool_or(category = 'corridor') AS has_corridor, count(*) FILTER (category = 'restroom') AS restrooms,
    bool_or(category IN ('mechanical','storage')) AS has_service, count(*) FILTER ((x1-x0)*(y1-y0) < 6 OR least(x1-x0, y1-y0) < 1.4) AS slivers,
    1.0::DOUBLE AS fill FROM units WHERE category <> 'outside' GROUP BY ALL"""))
def _(s):
    return quality.program_gates(s.units, s.footprints).select(
        *FLOOR, "has_corridor", "restrooms", "has_service", "slivers", r3("fill", "fill")
    )


@query("repeated_plan", o.sql(
    """SELECT a.building_id, a.ordinal, (SELECT count(*) FROM r p JOIN r q ON p.building_id = q.building_id AND q.ordinal = p.ordinal + 1 AND p.x0 = q.x0 AND p.y0 = q.y0 AND p.x1 = q.x1 AND p.y1 = q.y1
      WHERE p.building_id = a.building_id AND p.ordinal = a.ordinal) AS same, a.n, b.n AS n_above
    FROM n a JOIN n b ON a.building_id = b.building_id AND b.ordinal = a.ordinal + 1""",
    f"r AS (SELECT DISTINCT building_id, ordinal, x0, y0, x1, y1 FROM units WHERE {o.SPACE}), n AS (SELECT building_id, ordinal, count(*) AS n FROM r GROUP BY ALL)"))
def _(s):
    return quality.repeated_plan(s.units).select(*FLOOR, "same", "n", "n_above")


@query("camera_inventory", o.sql(
    """SELECT building_id, ordinal, kind, count(*) AS cameras, count(*) FILTER (coalesce(mp, 0) = 0) AS unrated,
    CAST(grouping(building_id, ordinal, kind) AS INTEGER) AS level FROM cameras GROUP BY ROLLUP (building_id, ordinal, kind)"""))
def _(s):
    return quality.camera_inventory(s.cameras)


@query("maintenance", o.sql(
    """SELECT building_id, coalesce(status, 'unknown') AS status, count(*) AS cameras, count(*) FILTER (serviced IS NULL) AS never_serviced,
    CAST(max(DATE '2024-06-01' - serviced) AS INTEGER) AS oldest_service_days, count(*) FILTER (coalesce(mp, 0) = 0) AS unrated FROM cameras GROUP BY ALL"""))
def _(s):
    return quality.maintenance(s.cameras, "2024-06-01")


CUT = """
gone AS (SELECT * FROM units WHERE security = 'restricted'),
kept AS (SELECT * FROM units WHERE coalesce(security, '') <> 'restricted')
"""


@query("visitor_cut", o.sql(
    """SELECT building_id, count(*) FILTER (t = 'units') AS units, count(*) FILTER (t = 'openings') AS openings, count(*) FILTER (t = 'verticals') AS verticals,
    count(*) FILTER (t = 'occupants') AS occupants, count(*) FILTER (t = 'fixtures') AS fixtures, count(*) FILTER (t = 'structures') AS structures, count(*) FILTER (t = 'amenities') AS amenities FROM (
      SELECT building_id, 'units' AS t FROM kept
      UNION ALL SELECT building_id, 'openings' FROM openings x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.building_id = x.building_id AND g.unit_id = x.unit_id)
      UNION ALL SELECT building_id, 'verticals' FROM verticals x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.building_id = x.building_id AND g.unit_id IN (x.unit_a, x.unit_b))
      UNION ALL SELECT building_id, 'occupants' FROM occupants x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.building_id = x.building_id AND g.unit_id = x.unit_id)
      UNION ALL SELECT building_id, 'fixtures' FROM fixtures x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.building_id = x.building_id AND g.ordinal = x.ordinal AND g.x0 < x.x1 AND x.x0 < g.x1 AND g.y0 < x.y1 AND x.y0 < g.y1)
      UNION ALL SELECT building_id, 'structures' FROM structures x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.building_id = x.building_id AND g.ordinal = x.ordinal AND g.x0 < x.x1 AND x.x0 < g.x1 AND g.y0 < x.y1 AND x.y0 < g.y1)
      UNION ALL SELECT building_id, 'amenities' FROM amenities x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.building_id = x.building_id AND g.ordinal = x.ordinal AND x.x >= g.x0 AND x.x < g.x1 AND x.y >= g.y0 AND x.y < g.y1))
    GROUP BY ALL""", CUT))
def _(s):
    names = ["buildings", "levels", "units", "openings", "verticals", "occupants", "fixtures", "structures", "amenities", "footprints"]
    t = visitor.visitor_cut({n: getattr(s, n) for n in names})
    parts = ["units", "openings", "verticals", "occupants", "fixtures", "structures", "amenities"]
    rows = None
    for p in parts:
        one = t[p].select("building_id", F.lit(p).alias("t"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("building_id").agg(*[F.count_if(F.col("t") == p).alias(p) for p in parts])


# -- routes ----------------------------------------------------------------

GRAPH = """
nodes AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM units WHERE coalesce(security, '') <> 'restricted'),
door AS (
  SELECT n.building_id, n.ordinal, CASE WHEN kind = 'entrance' THEN 'entrance:' ELSE 'door:' END || opening_id AS door, n.unit_id AS owner, h.unit_id AS hub, p.pos AS opening_pos, kind = 'entrance' AS is_entrance, ox, oy,
    sqrt((n.mx-ox)*(n.mx-ox)+(n.my-oy)*(n.my-oy)) AS w_owner, sqrt((ox-h.mx)*(ox-h.mx)+(oy-h.my)*(oy-h.my)) AS w_hub
  FROM openings p JOIN nodes n USING (building_id, unit_id) JOIN nodes h ON h.building_id = n.building_id AND h.ordinal = n.ordinal
    AND h.category = CASE WHEN kind = 'entrance' THEN 'outside' ELSE 'corridor' END),
rise AS (SELECT v.* FROM verticals v JOIN nodes a ON a.building_id = v.building_id AND a.unit_id = v.unit_a JOIN nodes b ON b.building_id = v.building_id AND b.unit_id = v.unit_b),
hop0 AS (
  SELECT building_id, owner AS src, hub AS dst, w_owner + w_hub AS w, '>' || door || '>' AS via FROM door
  UNION ALL SELECT building_id, hub, owner, w_owner + w_hub, '>' || door || '>' FROM door
  UNION ALL SELECT building_id, unit_a, unit_b, 6::DOUBLE, '>' FROM rise UNION ALL SELECT building_id, unit_b, unit_a, 6::DOUBLE, '>' FROM rise),
hop AS MATERIALIZED (SELECT building_id, src, dst, arg_min(w, (round(w, 6), via)) AS w, arg_min(via, (round(w, 6), via)) AS via FROM hop0 GROUP BY ALL),
deg AS (SELECT building_id, src AS node, count(*) AS n FROM hop GROUP BY ALL)
"""
WALK = """
walk AS (
  SELECT request_id, r.building_id, goal_id, start_id AS node, 0::DOUBLE AS cost, start_id AS path, [start_id] AS seen FROM routes r
    JOIN nodes a ON a.building_id = r.building_id AND a.unit_id = r.start_id JOIN nodes b ON b.building_id = r.building_id AND b.unit_id = r.goal_id
  UNION ALL
  SELECT w.request_id, w.building_id, w.goal_id, h.dst, w.cost + h.w, w.path || h.via || h.dst, list_append(w.seen, h.dst)
  FROM walk w JOIN hop h ON h.building_id = w.building_id AND h.src = w.node JOIN deg d ON d.building_id = h.building_id AND d.node = h.dst
  WHERE w.node <> w.goal_id AND NOT list_contains(w.seen, h.dst) AND (d.n > 1 OR h.dst = w.goal_id)),
best AS (SELECT request_id, arg_min(cost, (round(cost, 6), path)) AS cost, arg_min(path, (round(cost, 6), path)) AS path FROM walk WHERE node = goal_id GROUP BY ALL)
"""


def found_routes(s: Portfolio) -> DataFrame:
    return s.found_routes


@query("nav_edges", o.sql(
    """SELECT building_id, owner AS src, door AS dst, round(w_owner, 3) AS w FROM door UNION ALL SELECT building_id, door, owner, round(w_owner, 3) FROM door
    UNION ALL SELECT building_id, door, hub, round(w_hub, 3) FROM door UNION ALL SELECT building_id, hub, door, round(w_hub, 3) FROM door
    UNION ALL SELECT building_id, unit_a, unit_b, 6::DOUBLE FROM rise UNION ALL SELECT building_id, unit_b, unit_a, 6::DOUBLE FROM rise""", GRAPH))
def _(s):
    return navgraph.edges(navgraph.nav_graph(s.units, s.openings, s.verticals)).select("building_id", "src", "dst", r3("w", "w"))


@query("step_free_verticals", o.sql(
    "SELECT building_id, unit_a, unit_b FROM rise WHERE name NOT ILIKE '%stair%'", GRAPH))
def _(s):
    return navgraph.nav_graph(s.units, s.openings, s.verticals, step_free=True)["verticals"].select("building_id", "unit_a", "unit_b")


@query("routes", o.sql(
    "SELECT request_id, building_id, start_id, goal_id, round(cost, 3) AS cost, path FROM routes LEFT JOIN best USING (request_id)", GRAPH, WALK))
def _(s):
    return routes.routes(s.routes, s.units, s.openings, s.verticals).select("request_id", "building_id", "start_id", "goal_id", r3("cost", "cost"), F.concat_ws(">", "path").alias("path")).withColumn(
        "path", F.when(F.col("cost").isNotNull(), F.col("path")))


@query("egress", o.sql(
    """SELECT r.request_id, r.building_id, r.start_id, z.goal_id, round(z.cost, 3) AS cost FROM routes r LEFT JOIN (
      SELECT request_id, arg_min(door, (round(c, 6), opening_pos)) AS goal_id, min(c) AS cost FROM (
        SELECT w.request_id, d.door, d.opening_pos, w.cost + d.w_owner AS c FROM walk2 w JOIN door d ON d.building_id = w.building_id AND d.owner = w.node WHERE is_entrance
        UNION ALL SELECT w.request_id, d.door, d.opening_pos, w.cost + d.w_hub FROM walk2 w JOIN door d ON d.building_id = w.building_id AND d.hub = w.node WHERE is_entrance)
      GROUP BY ALL) z USING (request_id)""", GRAPH, """
walk2 AS (
  SELECT request_id, r.building_id, start_id AS node, 0::DOUBLE AS cost, [start_id] AS seen FROM routes r JOIN nodes a ON a.building_id = r.building_id AND a.unit_id = r.start_id
  UNION ALL
  SELECT w.request_id, w.building_id, h.dst, w.cost + h.w, list_append(w.seen, h.dst)
  FROM walk2 w JOIN hop h ON h.building_id = w.building_id AND h.src = w.node JOIN deg d ON d.building_id = h.building_id AND d.node = h.dst
  WHERE NOT list_contains(w.seen, h.dst) AND (d.n > 1 OR h.dst IN (SELECT owner FROM door WHERE is_entrance)))"""))
def _(s):
    return routes.egress(s.routes, s.units, s.openings, s.verticals).select(
        "request_id", "building_id", "start_id", "goal_id", r3("cost", "cost"))


@query("route_totals")
def _(s):
    gm = routes.route_geometry(found_routes(s), s.units, s.openings, s.verticals, scene_walls(s))
    return gm["totals"].select("request_id", "building_id", r3("metres", "metres"), F.concat_ws(">", F.transform("floors", lambda f: f.cast("string"))).alias("floors"), "eta_min")


@query("route_lines")
def _(s):
    gm = routes.route_geometry(found_routes(s), s.units, s.openings, s.verticals, scene_walls(s))
    return gm["lines"].select("request_id", "building_id", "run", "ordinal", r3("metres", "metres"), F.size("line").alias("points"))


@query("route_markers", o.sql(
    """SELECT request_id, building_id, ordinal, node, 'transition' AS kind FROM z WHERE coalesce(b, ordinal) <> ordinal OR coalesce(a, ordinal) <> ordinal
    UNION ALL SELECT request_id, building_id, ordinal, node, 'start' FROM z WHERE i = 0 UNION ALL SELECT request_id, building_id, ordinal, node, 'end' FROM z WHERE i = n - 1""", GRAPH, WALK, """
    p AS (SELECT request_id, building_id, unnest(string_split(path, '>')) AS node, generate_subscripts(string_split(path, '>'), 1) - 1 AS i, len(string_split(path, '>')) AS n FROM best JOIN routes USING (request_id)),
    q AS (SELECT p.*, coalesce(u.ordinal, d.ordinal) AS ordinal FROM p LEFT JOIN units u ON u.building_id = p.building_id AND u.unit_id = p.node LEFT JOIN door d ON d.building_id = p.building_id AND d.door = p.node),
    z AS (SELECT *, lag(ordinal) OVER w AS b, lead(ordinal) OVER w AS a FROM q WINDOW w AS (PARTITION BY request_id ORDER BY i))"""))
def _(s):
    gm = routes.route_geometry(found_routes(s), s.units, s.openings, s.verticals, scene_walls(s))
    return gm["points"].select("request_id", "building_id", "ordinal", "node", "kind")


@query("route_steps")
def _(s):
    return directions.route_steps(found_routes(s), s.units, s.openings, s.verticals, s.levels).select(
        "request_id", "building_id", "step", "ordinal", "text")


@query("route_endpoints", o.sql(
    """SELECT building_id, 'u:' || unit_id AS token, unit_id, name FROM units WHERE category NOT IN ('corridor','elevator','stairs') AND coalesce(security, '') <> 'restricted'
    UNION ALL SELECT o.building_id, 'o:' || occupant_id, o.unit_id, o.name FROM occupants o JOIN units u USING (building_id, unit_id) WHERE u.category NOT IN ('corridor','elevator','stairs') AND coalesce(security, '') <> 'restricted'"""))
def _(s):
    return routes.selectable_endpoints(s.units, s.occupants)


@query("default_endpoints", o.sql(
    """SELECT building_id, arg_min(unit_id, pos) AS start_id, arg_max(unit_id, pos) AS goal_id FROM units
    WHERE category NOT IN ('corridor','elevator','stairs') AND coalesce(security, '') <> 'restricted' GROUP BY ALL"""))
def _(s):
    return routes.default_endpoints(s.units)


@query("reachability", o.sql(
    """SELECT n.building_id, n.ordinal, n.unit_id, coalesce(x.hit, false) AS reachable FROM nodes n LEFT JOIN (
      SELECT DISTINCT building_id, node, true AS hit FROM flood) x ON x.building_id = n.building_id AND x.node = n.unit_id WHERE category <> 'outside'""", GRAPH, """
flood AS (SELECT building_id, owner AS node FROM door WHERE is_entrance
  UNION SELECT h.building_id, h.dst FROM flood f JOIN hop h ON h.building_id = f.building_id AND h.src = f.node)"""))
def _(s):
    return navgraph.reachable_units(navgraph.nav_graph(s.units, s.openings, s.verticals), s.units)


# -- windows, edits, patrols ----------------------------------------------

from floorlens.operators import edits  # noqa: E402
from floorlens.plans import patrol, scene3d  # noqa: E402
from floorlens.sources import building_file, cad, geojson, report, schedule, svg  # noqa: E402
from floorlens.streaming import live  # noqa: E402


@query("edit_units", o.sql(
    """SELECT user_id, count(*) AS edits, CAST(sum(fresh) AS BIGINT) AS undo_units FROM (
      SELECT o_custkey AS user_id, CASE WHEN o_orderpriority = lag(o_orderpriority) OVER w AND epoch_ms(o_orderdate) - epoch_ms(lag(o_orderdate) OVER w) < 2592000000 THEN 0 ELSE 1 END AS fresh
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) GROUP BY ALL"""))
def _(s):
    # Orders lie months apart, so the gap here is thirty days.
    return edits.coalesce_edits(s.edits, gap_ms=30 * 86_400_000).groupBy("user_id").agg(
        F.count("*").alias("edits"), F.max("undo_unit").alias("undo_units")
    )


@query("edit_sessions", o.sql(
    """SELECT user_id, edit_key, min(ts) AS started, count(*) AS edits FROM (SELECT *, sum(f) OVER (PARTITION BY user_id, edit_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT o_custkey AS user_id, o_orderpriority AS edit_key, o_orderdate AS ts,
        CASE WHEN o_orderdate - lag(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate) <= INTERVAL 30 DAY THEN 0 ELSE 1 END AS f FROM orders)) GROUP BY user_id, edit_key, g"""))
def _(s):
    return live.edit_sessions(s.edits, "30 days").select("user_id", "edit_key", "started", "edits")


@query("handoffs", o.sql(
    """SELECT subject, probe_id, now AS camera_id FROM walk""", o.WALLS, o.RINGS, o.seen("probes", "probe_id"),
    """cams AS MATERIALIZED (SELECT p.subject, p.probe_id, v.cams, row_number() OVER (PARTITION BY p.subject ORDER BY p.ts, p.probe_id) AS n
    FROM probes p LEFT JOIN (SELECT probe_id, list(camera_id ORDER BY score DESC, cam_pos) AS cams FROM seen GROUP BY probe_id) v USING (probe_id)),
  walk AS (SELECT subject, n, probe_id, cams[1] AS now, cams[1] AS held FROM cams WHERE n = 1
    UNION ALL SELECT c.subject, c.n, c.probe_id, CASE WHEN list_contains(c.cams, w.held) THEN w.held ELSE c.cams[1] END,
      CASE WHEN list_contains(c.cams, w.held) THEN w.held ELSE coalesce(c.cams[1], w.held) END
    FROM walk w JOIN cams c ON c.subject = w.subject AND c.n = w.n + 1)"""))
def _(s):
    seen = probe.see(s.probes, s.cameras, scene_rings(s))
    return patrol.handoffs(s.probes, seen).select("subject", "probe_id", "camera_id")


@query("patrol_fixes", o.sql(
    """SELECT building_id, ordinal, i AS fix, round(CASE WHEN (i * 1.2::DOUBLE) % 116 <= 58 THEN 1 + (i * 1.2::DOUBLE) % 116 ELSE 1 + 116 - (i * 1.2::DOUBLE) % 116 END, 3) AS x, 6.5::DOUBLE AS y
    FROM floors, range(141) t(i)"""))
def _(s):
    return patrol.trajectory(s.patrols).select(*FLOOR, "fix", r3("at.x", "x"), F.col("at.y").alias("y"))


@query("patrol_tour", o.sql(
    f"""SELECT building_id, ordinal, unit_id, row_number() OVER (PARTITION BY building_id, ordinal ORDER BY unit_id <> start, round(w, 6), pos) AS stop FROM (
      SELECT n.building_id, n.ordinal, n.unit_id, n.pos, h.w, first_value(n.unit_id) OVER (PARTITION BY n.building_id, n.ordinal ORDER BY n.pos) AS start0 , s.start
      FROM nodes n JOIN hop h ON h.building_id = n.building_id AND h.src = n.unit_id JOIN nodes c ON c.building_id = h.building_id AND c.unit_id = h.dst AND c.category = 'corridor'
      JOIN (SELECT building_id, ordinal, arg_min(unit_id, pos) AS start FROM nodes WHERE {o.SPACE} GROUP BY ALL) s ON s.building_id = n.building_id AND s.ordinal = n.ordinal
      WHERE n.{o.SPACE}
        AND EXISTS (SELECT 1 FROM hop z JOIN nodes zc ON zc.building_id = z.building_id AND zc.unit_id = z.dst AND zc.category = 'corridor' WHERE z.building_id = n.building_id AND z.src = s.start))""",
    GRAPH))
def _(s):
    return patrol.auto_patrol(s.units, s.openings, s.verticals, s.patrols)["tour"].select(*FLOOR, "unit_id", "stop")


@query("patrol_points")
def _(s):
    t = patrol.auto_patrol(s.units, s.openings, s.verticals, s.patrols)["tour"]
    return patrol.tour_points(t, s.units, s.openings, s.verticals).select(*FLOOR, "seq", "node", r3("at.x", "x"), r3("at.y", "y"))


@query("bulk_security", o.sql(
    "SELECT building_id, coalesce(CASE WHEN category = 'storage' THEN 'secure' ELSE security END, 'public') AS security, count(*) AS units FROM units GROUP BY ALL"))
def _(s):
    u = edits.bulk_set(s.units, s.units.where("category = 'storage'"), "security", "secure")
    return u.groupBy("building_id", labels.security_of(F.col("security")).alias("security")).agg(F.count("*").alias("units"))


@query("delete_cascade", o.sql(
    """SELECT 'units' AS kept, building_id, unit_id AS id FROM units WHERE (building_id, unit_id) NOT IN (SELECT (building_id, unit_id) FROM gone)
    UNION ALL SELECT 'openings', building_id, opening_id FROM openings WHERE (building_id, unit_id) NOT IN (SELECT (building_id, unit_id) FROM gone)
    UNION ALL SELECT 'occupants', building_id, occupant_id FROM occupants WHERE (building_id, unit_id) NOT IN (SELECT (building_id, unit_id) FROM gone)
    UNION ALL SELECT 'verticals', building_id, unit_a || '-' || unit_b FROM verticals
      WHERE (building_id, unit_a) NOT IN (SELECT (building_id, unit_id) FROM gone) AND (building_id, unit_b) NOT IN (SELECT (building_id, unit_id) FROM gone)""",
    "gone AS (SELECT building_id, unit_id FROM units WHERE category = 'storage' OR (category = 'stairs' AND pos % 3 = 0))"))
def _(s):
    gone = s.units.where("category = 'storage' or (category = 'stairs' and pos % 3 = 0)")
    t = visitor.without_units(gone, s.units, s.openings, s.verticals, s.occupants)
    ids = {"units": F.col("unit_id"), "openings": F.col("opening_id"), "occupants": F.col("occupant_id"), "verticals": F.concat_ws("-", "unit_a", "unit_b")}
    rows = [t[n].select(F.lit(n).alias("kept"), "building_id", c.alias("id")) for n, c in ids.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("apply_edits", o.sql(
    """SELECT building_id, camera_id, round((pos * 7 + 725) % 360, 3)::DOUBLE AS heading, 'Renamed ' || pos AS name, rng AS range_m FROM cameras"""))
def _(s):
    j = lambda field, v, seq: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value"), F.lit(seq).alias("seq"))
    log = s.cameras.select(
        "building_id", F.lit("cameras").alias("entity"), F.col("camera_id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.inline(F.array(
            j("heading", F.lit(1.0), 1), j("heading", F.col("pos") * 7.0 + 725, 2),
            j("name", F.concat(F.lit('"Renamed '), "pos", F.lit('"')), 1),
        )),
    )
    return edits.apply_edits(s.cameras, "cameras", "camera_id", log).select("building_id", "camera_id", r3("heading", "heading"), "name", "range_m")


@query("free_preset_slots", o.sql(
    """SELECT building_id, camera_id, CAST(CASE WHEN pos % 8 + 2 = 2 THEN 3 ELSE 2 END AS INTEGER) AS slot FROM cameras WHERE kind = 'ptz'"""))
def _(s):
    return edits.free_slots(s.camera_presets)


@query("home_presets", o.sql(
    "SELECT building_id, camera_id, heading FROM cameras WHERE kind = 'ptz' AND pos % 2 = 1"))
def _(s):
    return edits.home_presets(s.cameras.where("kind = 'ptz'"), s.cameras, s.camera_presets).select("building_id", "camera_id", "heading")


@query("default_names", o.sql(
    """SELECT u.building_id, u.unit_id, upper(u.category[1]) || u.category[2:] || ' ' || (n.n + row_number() OVER (PARTITION BY u.building_id, u.category ORDER BY u.pos)) AS name
    FROM units u JOIN (SELECT building_id, category, count(*) AS n FROM units GROUP BY ALL) n USING (building_id, category) WHERE u.name = ''"""))
def _(s):
    return places.default_names(s.units.where("name = ''"), s.units).select("building_id", "unit_id", "name")


@query("camera_names", o.sql(
    """SELECT building_id, ordinal, incident_id, 'Camera ' || (coalesce(n, 0) + row_number() OVER (PARTITION BY building_id, ordinal ORDER BY probe_id)) AS name
    FROM incidents LEFT JOIN (SELECT building_id, ordinal, count(*) AS n FROM cameras GROUP BY ALL) USING (building_id, ordinal)"""))
def _(s):
    put = s.incidents.withColumn("pos", F.substring("incident_id", 2, 20).cast("long"))
    return places.camera_names(put, s.cameras).select(*FLOOR, "incident_id", "name")


@query("patrol_names", o.sql(
    """SELECT building_id, ordinal, 'Auto patrol ' || (count(*) OVER (PARTITION BY building_id) + row_number() OVER (PARTITION BY building_id ORDER BY ordinal)) AS name
    FROM floors"""))
def _(s):
    return places.patrol_names(s.patrols.select(*FLOOR), s.patrols).select(*FLOOR, "name")


@query("changed_cameras", o.sql(
    "SELECT building_id, camera_id, ((heading + 365 - pos % 2 * 5) % 360)::DOUBLE AS heading FROM cameras WHERE kind = 'ptz' AND pos % 2 = 0"))
def _(s):
    aims = s.cameras.where("kind = 'ptz'").select(
        "building_id", "camera_id", F.lit("2024-01-01").cast("timestamp").alias("ts"),
        (F.col("heading") + 365 - F.col("pos") % 2 * 5).alias("heading"), "tilt_deg", "fov_deg", "range_m")
    return live.changed_cameras(s.cameras, aims).select("building_id", "camera_id", "heading")


# -- scene in height -------------------------------------------------------


@query("scene_walls", o.sql(
    """SELECT building_id, ordinal, least(ax,bx) AS x1, least(ay,by) AS y1, greatest(ax,bx) AS x2, greatest(ay,by) AS y2, max(top) AS top_m,
    arg_max(finish, (rank_, -pos)) AS finish, count(*) AS sides FROM (
      SELECT w.building_id, w.ordinal, ax, ay, bx, by, coalesce(ceiling_m, 3.2)::DOUBLE AS top,
        CASE WHEN source = 'footprint' THEN 2147483647 ELSE u.pos END AS pos, coalesce(u.category, 'envelope') AS finish,
        CASE coalesce(u.category, 'envelope') WHEN 'envelope' THEN 100 WHEN 'retail' THEN 60 WHEN 'room' THEN 50 WHEN 'office' THEN 45 WHEN 'restroom' THEN 40 WHEN 'mechanical' THEN 35 WHEN 'storage' THEN 30 ELSE 25 END AS rank_
      FROM walls w JOIN levels l USING (building_id, ordinal) LEFT JOIN units u ON u.building_id = w.building_id AND u.unit_id = w.source_id AND source = 'unit'
      WHERE source = 'footprint' OR (source = 'unit' AND u.category NOT IN ('corridor','lobby','outside'))) GROUP BY ALL""", o.WALLS))
def _(s):
    w = scene3d.merged_walls(s.units, s.footprints, s.levels)
    return w.select(
        *FLOOR, F.least("ax", "bx").alias("x1"), F.least("ay", "by").alias("y1"), F.greatest("ax", "bx").alias("x2"),
        F.greatest("ay", "by").alias("y2"), "top_m", "finish", "sides",
    )


@query("scene_holes", o.sql(
    """SELECT o.building_id, u.ordinal, o.opening_id, st AS style, round(3 - CASE WHEN st = 'storefront' THEN 0 ELSE 0 END, 3)::DOUBLE AS at_m,
    CASE st WHEN 'storefront' THEN 5.3::DOUBLE WHEN 'opening' THEN 2.6::DOUBLE WHEN 'double' THEN 1.8::DOUBLE ELSE 0.95::DOUBLE END AS width_m,
    round(least(CASE st WHEN 'storefront' THEN 3.0 WHEN 'opening' THEN 2.6 WHEN 'double' THEN 2.25 ELSE 2.1 END, coalesce(ceiling_m, 3.2) - 0.12), 3)::DOUBLE AS head_m
    FROM openings o JOIN units u USING (building_id, unit_id) JOIN levels l USING (building_id, ordinal),
    LATERAL (SELECT CASE WHEN kind = 'entrance' THEN 'double' WHEN category = 'retail' THEN 'storefront' WHEN category = 'room' THEN 'opening' ELSE 'door' END AS st)
    WHERE category NOT IN ('corridor','lobby','outside')"""))
def _(s):
    w = scene3d.merged_walls(s.units, s.footprints, s.levels)
    return scene3d.wall_holes(s.openings, s.units, s.occupants, s.levels, w).select(
        *FLOOR, "opening_id", "style", r3("at_m", "at_m"), r3("width", "width_m"), r3("head_m", "head_m"))


@query("scene_prisms", o.sql(
    """SELECT building_id, ordinal, 'slab' AS prism, unit_id AS id, 0::DOUBLE AS base_m, 0.15::DOUBLE AS top_m FROM units WHERE category IN ('corridor','lobby')
    UNION ALL SELECT building_id, ordinal, 'structure', structure_id, least(coalesce(base_m, 0), t), t FROM (SELECT s.*, least(coalesce(height_m, 1e9), coalesce(ceiling_m, 3.2))::DOUBLE AS t FROM structures s JOIN levels USING (building_id, ordinal))
    UNION ALL SELECT building_id, ordinal, 'fixture', fixture_id, 0, h FROM (SELECT *, CASE kind WHEN 'slot' THEN 1.6 WHEN 'bar' THEN 1.1 WHEN 'counter' THEN 1.1 WHEN 'stage' THEN 0.6 WHEN 'planter' THEN 0.5 WHEN 'seating' THEN 0.45
      WHEN 'car' THEN 1.4 WHEN 'parking' THEN 0 WHEN 'unknown' THEN 0.8 ELSE 0.9 END::DOUBLE AS h FROM fixtures) WHERE h > 0"""))
def _(s):
    return scene3d.prisms(s.units, s.structures, s.fixtures, s.levels).select(*FLOOR, "prism", "id", "base_m", "top_m")


@query("camera_poses", o.sql(
    f"""SELECT building_id, camera_id, greatest(0.1, least(coalesce(mount, least(greatest(4, c - 0.6), 7)), c - 0.1))::DOUBLE AS mount_m, coalesce(tilt, 0)::DOUBLE AS tilt_deg,
    round(2 * atan(tan(least(greatest(fov, 1), 179) * {o.PI} / 360) * 0.5625) * 180 / {o.PI}, 3) AS vfov_deg, c + 0.45 AS storey_m
    FROM (SELECT x.*, coalesce(ceiling_m, 3.2)::DOUBLE AS c FROM cameras x JOIN levels USING (building_id, ordinal))"""))
def _(s):
    return scene3d.camera_poses(s.cameras, s.levels).select("building_id", "camera_id", "mount_m", "tilt_deg", r3("vfov_deg", "vfov_deg"), "storey_m")


@query("scene_voids", o.sql(
    """SELECT building_id, CAST(ordinal - k AS INTEGER) AS ordinal, CASE k WHEN 0 THEN 'plate' ELSE 'ceiling' END AS surface FROM floors, range(2) t(k) WHERE ordinal > 0 AND building_id % 2 = 0"""))
def _(s):
    return scene3d.voids(s.voids).select(*FLOOR, "surface")


# -- sources and sinks -----------------------------------------------------


def geo_features(s):
    return geojson.features(s.buildings, s.units, s.openings, s.verticals, s.cameras, s.occupants)


def whole_documents(lines: DataFrame) -> DataFrame:
    """Documents as single cells, for reading back in one query."""
    return lines.groupBy("building_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "pos", "line"))), lambda v: v["line"]), "\n").alias("text")
    ).withColumnRenamed("building_id", "file_id")


@query("geojson_features", o.sql(
    """SELECT building_id, section, count(*) AS features FROM (SELECT building_id, 0 AS section FROM units UNION ALL SELECT building_id, 1 FROM openings
    UNION ALL SELECT building_id, 2 FROM verticals UNION ALL SELECT building_id, 3 FROM cameras UNION ALL SELECT building_id, 4 FROM occupants) GROUP BY ALL"""))
def _(s):
    return geo_features(s).where("feature is not null").groupBy("building_id", "section").agg(F.count("*").alias("features"))


@query("geojson_round_trip", o.sql(
    """SELECT building_id, unit_id, ordinal, name, category, round(x0, 3) AS x0, round(y1, 3) AS y1 FROM units"""))
def _(s):
    lines = geojson.document_lines(geo_features(s), s.buildings, s.levels, s.verticals)
    b = g.bbox(F.col("polygon"))
    return geojson.read_documents(whole_documents(lines))["units"].select(
        F.col("file_id").alias("building_id"), "unit_id", "ordinal", "name", "category", (r3(b["x0"]) + 0.0).alias("x0"), (r3(b["y1"]) + 0.0).alias("y1"))


@query("archive_counts", o.sql(
    """SELECT 'venue' AS t, count(*) AS n FROM buildings UNION ALL SELECT 'building', count(*) FROM buildings UNION ALL SELECT 'level', count(*) FROM floors
    UNION ALL SELECT 'unit', count(*) FROM units UNION ALL SELECT 'opening', count(*) FROM openings UNION ALL SELECT 'anchor', count(*) FROM occupants UNION ALL SELECT 'occupant', count(*) FROM occupants
    UNION ALL SELECT 'camera', count(*) FROM cameras UNION ALL SELECT 'structure', count(*) FROM structures UNION ALL SELECT 'manifest', count(*) FROM buildings
    UNION ALL SELECT 'zone', count(*) FROM (SELECT DISTINCT building_id, coalesce(security, 'public') FROM units)"""))
def _(s):
    t = geojson.archive(s.buildings, s.levels, s.units, s.openings, s.occupants, s.cameras, s.structures, s.verticals)
    rows = None
    for n, d in t.items():
        one = d.where("feature is not null").select(F.lit(n).alias("t"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("t").agg(F.count("*").alias("n"))


@query("extents", o.sql(
    "SELECT building_id, ordinal, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM units GROUP BY ALL"))
def _(s):
    return geojson.extents(s.units, s.levels)["level"].drop("name")


SAVED = {"levels": "ordinal", "units": "unit_id", "openings": "opening_id", "verticals": "unit_a", "cameras": "camera_id", "incidents": "incident_id",
         "patrols": "patrol_id", "amenities": "amenity_id", "fixtures": "fixture_id", "footprints": "ordinal", "structures": "structure_id", "voids": "void_id",
         "occupants": "occupant_id", "camera_views": "view_id", "camera_presets": "camera_id"}


def saves(s: Portfolio) -> DataFrame:
    """Every building written to a file of its own and read back from there."""
    path = f"{shared_folder(s.units.sparkSession)}/tables/{uuid.uuid4().hex}-saves"
    building_file.write_saves(s.buildings, {n: getattr(s, n) for n in SAVED}, path)
    return building_file.read_saves(s.units.sparkSession, path)


@query("building_files", o.sql(
    """SELECT building_id, ordinal, unit_id, CAST(row_number() OVER (PARTITION BY building_id ORDER BY pos) - 1 AS INTEGER) AS pos, name, category, security FROM units"""))
def _(s):
    return building_file.units_table(saves(s)).drop("polygon")


@query("save_round_trip", o.sql(
    " UNION ALL ".join(f"SELECT '{n}' AS collection, building_id, count(*) AS items, sha256(string_agg({k}::VARCHAR, ',' ORDER BY {k}::VARCHAR)) AS ids FROM {t} GROUP BY building_id"
        for n, k, t in [(n, k, {"camera_views": "views", "camera_presets": "presets"}.get(n, n)) for n, k in SAVED.items()]),
    "footprints AS (SELECT * FROM floors)", "patrols AS (SELECT *, 'pt' || building_id || '-' || ordinal AS patrol_id FROM floors)",
    "voids AS (SELECT *, 'v' || building_id || '-' || ordinal AS void_id FROM floors WHERE ordinal > 0 AND building_id % 2 = 0)",
    "views AS (SELECT building_id, 'v' || pos AS view_id FROM cameras WHERE pos % 10 = 0)",
    "presets AS (SELECT building_id, camera_id FROM cameras WHERE kind = 'ptz' AND pos % 2 = 0 UNION ALL SELECT building_id, camera_id FROM cameras WHERE kind = 'ptz')"))
def _(s):
    t = building_file.tables(saves(s))
    rows = [t[n].select(F.lit(n).alias("collection"), "building_id", F.col(k).cast("string").alias("id")) for n, k in SAVED.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    ids = F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256)
    return every.groupBy("collection", "building_id").agg(F.count("*").alias("items"), ids.alias("ids"))


@query("saved_or_pristine", o.sql(
    """SELECT 'b' || building_id AS property_id, CASE WHEN building_id % 3 = 0 AND building_id % 2 = 0 AND building_id % 4 = 0 THEN 'saved'
      WHEN building_id % 3 <> 0 AND building_id % 2 = 0 THEN 'saved' ELSE 'pristine' END AS origin FROM buildings"""))
def _(s):
    b = s.buildings.withColumn("property_id", F.concat(F.lit("b"), "building_id"))
    pristine = b.select("property_id", "rev", F.lit("p").alias("doc"))
    saved = b.select("property_id", (F.col("building_id") % 2 == 0).alias("ok"), F.when(F.col("building_id") % 4 == 0, 2).otherwise(1).alias("rev"), F.lit("s").alias("doc"))
    return building_file.saved_or_pristine(saved, pristine).select("property_id", "origin")


# Ids in use: every third customer's segment with that customer's number as its
# ending, from 2 to 99, and the bare segments that start before G.
@query("property_slugs", o.sql(
    """SELECT seq, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS id FROM (
      SELECT *, row_number() OVER (PARTITION BY s ORDER BY seq) AS k FROM (SELECT c_custkey AS seq, lower(c_mktsegment) AS s FROM customer))
    JOIN free USING (s, k)""",
    """used AS (SELECT DISTINCT lower(c_mktsegment) AS s, c_custkey % 98 + 2 AS n FROM customer WHERE c_custkey % 3 = 0
      UNION SELECT DISTINCT lower(c_mktsegment), 1 FROM customer WHERE c_mktsegment < 'G'),
    free AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY n) AS k FROM (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer),
      range(1, (SELECT count(*) + 101 FROM customer)) t(n) WHERE (s, n) NOT IN (SELECT (s, n) FROM used))"""))
def _(s):
    names = s.customer_names
    low = F.lower("name")
    suffixed = names.where("seq % 3 = 0").select(F.concat_ws("-", low, (F.col("seq") % 98 + 2).cast("string")).alias("id"))
    taken = suffixed.unionByName(names.where("name < 'G'").select(low.alias("id"))).distinct()
    return building_file.new_property_ids(names, taken).select("seq", "id")


@query("schedule_rows", o.sql(
    """SELECT k AS file_id, c_name AS name, CAST(k + 1 AS INTEGER) AS op_number, round((k % 12 + 1) / 3.28084, 3) AS mount_m,
    k % 3 = 0 AS rated FROM (SELECT c_custkey AS k, c_name FROM customer)"""))
def _(s):
    got = schedule.parse_schedules(s.schedule_files)["rows"]
    return got.select(F.col("file_id").cast("bigint").alias("file_id"), "name", "op_number", r3("mount_m", "mount_m"), F.col("spec").isNotNull().alias("rated"))


# A schedule with one row for every camera, a new camera for every fifth, and a
# second row for some of the new ones. Numbers asked for are free, the camera's
# own, or held by the building's camera before it.
ROWS = f"""
asked AS (
  SELECT building_id, CAST(pos AS BIGINT) AS seq, upper(name) AS name,
    CASE WHEN pos % 2 = 0 THEN 'axis p3265-lve mk ii' WHEN pos % 3 = 0 THEN 'House brand' END AS model,
    CASE WHEN pos % 5 = 2 AND pos > nb THEN pos - nb + 1 WHEN pos % 4 = 0 THEN pos + 1 END AS number,
    CASE WHEN pos % 3 = 1 THEN pos % 9 + 0.5::DOUBLE END AS mount, CASE WHEN pos % 2 = 1 THEN '172.16.0.' || pos % 200 END AS ip,
    CASE WHEN pos % 7 = 0 THEN 'R' || pos END AS serial, CASE WHEN pos % 6 = 0 THEN 'rtsp://new/' || pos END AS stream,
    CASE WHEN pos % 10 = 0 THEN 'n' || pos END AS notes, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM cameras, nbt
  UNION ALL SELECT building_id, pos + 10000000, 'New ' || pos, CASE WHEN pos % 15 = 0 THEN 'axis p3265-lve mk ii' END, pos + 20000000, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN pos % 10 = 0 THEN (pos % 50)::DOUBLE END, CASE WHEN pos % 10 = 0 THEN (pos % 12)::DOUBLE END FROM cameras WHERE pos % 5 = 0
  UNION ALL SELECT building_id, pos + 20000000, 'new ' || pos, NULL, NULL, 2.25, NULL, NULL, NULL, 'again', NULL, NULL FROM cameras WHERE pos % 25 = 0),
granted AS (
  SELECT a.*, lower(a.name) AS key, CASE WHEN h.op_number IS NULL THEN number END AS grant FROM asked a
  LEFT JOIN (SELECT building_id, op_number FROM cameras WHERE op_number IS NOT NULL) h ON h.building_id = a.building_id AND h.op_number = a.number),
patch AS (
  SELECT building_id, key, min(seq) AS first, arg_min(name, seq) AS name, arg_min(x, seq) AS x, arg_min(y, seq) AS y, max(model) AS model, max(grant) AS grant, max(mount) AS mount,
    max(ip) AS ip, max(serial) AS serial, max(stream) AS stream, max(notes) AS notes FROM granted GROUP BY ALL),
spec AS (SELECT 'axis p3265-lve mk ii' AS model, 'Axis P3265-LVE' AS label, 'fixed' AS kind, 100::DOUBLE AS fov, 2::DOUBLE AS mp),
patched AS (
  SELECT p.*, coalesce(s.label, p.model) AS m, s.kind, s.fov, s.mp, s.reach FROM patch p
  LEFT JOIN (SELECT *, least(60, floor({PX.format(d='1')} / 62 * 10 + 0.5) / 10) AS reach FROM spec) s USING (model)),
fresh AS (SELECT p.*, row_number() OVER (PARTITION BY building_id, x IS NULL ORDER BY first) - 1 AS slot FROM patched p
  WHERE (building_id, key) NOT IN (SELECT (building_id, lower(name)) FROM cameras))
"""


@query("schedule_upsert", o.sql(
    """SELECT c.building_id, c.ordinal, c.name, cx AS x, cy AS y, coalesce(p.kind, c.kind) AS kind, coalesce(p.fov, c.fov) AS fov_deg, round(coalesce(p.reach, c.rng), 3) AS range_m,
    coalesce(p.m, c.model) AS model, coalesce(p.mp, c.mp) AS resolution_mp, CAST(coalesce(p.grant, c.op_number) AS INTEGER) AS op_number, coalesce(p.mount, c.mount) AS mount_m,
    coalesce(p.ip, '10.0.' || c.pos % 250 || '.' || c.pos % 200) AS ip_address, coalesce(p.serial, CASE WHEN c.pos % 2 = 0 THEN 'SN' || c.pos END) AS serial,
    coalesce(p.stream, CASE WHEN c.pos % 2 = 1 THEN 'rtsp://nvr/' || c.pos END) AS stream_ref, p.notes
    FROM (SELECT *, CASE WHEN pos % 3 = 0 THEN """ + o._list([f"{m[0]} {m[1]}" for m in catalogue.CAMERA_MODELS]) + """[pos % 18 + 1] END AS model FROM cameras) c
    JOIN patched p ON p.building_id = c.building_id AND p.key = lower(c.name)
    UNION ALL SELECT building_id, 0, name, coalesce(x, slot * 3)::DOUBLE, coalesce(y, -12), coalesce(kind, 'fixed'), coalesce(fov, 90), round(coalesce(reach, 8), 3),
    m, mp, CAST(grant AS INTEGER), mount, ip, serial, stream, notes FROM fresh""", ROWS))
def _(s):
    p, nb = F.col("pos"), s.buildings.count()
    held = lambda c, v: F.when(c, v)
    none = lambda t: F.lit(None).cast(t)
    every = s.cameras.select(
        "building_id", p.cast("long").alias("seq"), F.upper("name").alias("name"), held(p % 2 == 0, F.lit("axis p3265-lve mk ii")).when(p % 3 == 0, "House brand").alias("model"),
        F.when((p % 5 == 2) & (p > nb), p - nb + 1).when(p % 4 == 0, p + 1).cast("int").alias("op_number"), none("double").alias("x"), none("double").alias("y"),
        held(p % 3 == 1, p % 9 + 0.5).cast("double").alias("mount_m"), held(p % 2 == 1, F.concat(F.lit("172.16.0."), p % 200)).alias("ip_address"),
        held(p % 7 == 0, F.concat(F.lit("R"), p)).alias("serial"), held(p % 6 == 0, F.concat(F.lit("rtsp://new/"), p)).alias("stream_ref"), held(p % 10 == 0, F.concat(F.lit("n"), p)).alias("notes"),
    )
    new = s.cameras.where("pos % 5 = 0").select(
        "building_id", (p + 10_000_000).cast("long").alias("seq"), F.concat(F.lit("New "), p).alias("name"), held(p % 15 == 0, F.lit("axis p3265-lve mk ii")).alias("model"),
        (p + 20_000_000).cast("int").alias("op_number"), held(p % 10 == 0, p % 50).cast("double").alias("x"), held(p % 10 == 0, p % 12).cast("double").alias("y"),
        none("double").alias("mount_m"), *[none("string").alias(n) for n in ("ip_address", "serial", "stream_ref", "notes")],
    )
    again = s.cameras.where("pos % 25 = 0").select(
        "building_id", (p + 20_000_000).cast("long").alias("seq"), F.concat(F.lit("new "), p).alias("name"), none("string").alias("model"), none("int").alias("op_number"),
        none("double").alias("x"), none("double").alias("y"), F.lit(2.25).alias("mount_m"), *[none("string").alias(n) for n in ("ip_address", "serial", "stream_ref")], F.lit("again").alias("notes"),
    )
    rows = every.unionByName(new).unionByName(again).withColumn("spec", catalogue.resolve_model(F.col("model")))
    return schedule.upsert(s.cameras, rows, s.units)["cameras"].select(
        *FLOOR, "name", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "kind", "fov_deg", r3("range_m", "range_m"), "model", "resolution_mp", "op_number", "mount_m",
        "ip_address", "serial", "stream_ref", "notes")


def _blocks(s):
    none = lambda t: F.lit(None).cast(t)
    return s.cad_entities.where("block is not null").select("file_id", "block").distinct().select(
        "file_id", "block", g.pt(0, 0).alias("base"), F.lit("LINE").alias("b_type"), F.lit("X-BLOCK").alias("b_layer"),
        F.array(g.pt(0, 0), g.pt(500, 0)).alias("b_vertices"), F.lit(False).alias("b_closed"), none(g.POINT).alias("b_center"),
        none("double").alias("b_radius"), none("double").alias("b_start_angle"), none("double").alias("b_end_angle")).where("block != 'B2'")


@query("cad_layers", o.sql(
    """SELECT file_id, layer, count(*) AS entities FROM (
      SELECT l_orderkey // 400 AS file_id, CASE WHEN t = 'INSERT' THEN 'X-BLOCK' WHEN l_linenumber % 4 = 0 THEN 'A-DOOR' ELSE l_returnflag END AS layer
      FROM (SELECT *, ['LINE','LWPOLYLINE','CIRCLE','ARC','SPLINE','INSERT'][(l_orderkey + l_linenumber) % 6 + 1] AS t FROM lineitem)
      WHERE t <> 'SPLINE' AND NOT (t = 'INSERT' AND l_linenumber % 3 = 2)) GROUP BY ALL"""))
def _(s):
    out = cad.normalise(s.cad_entities, _blocks(s), cad.unit_factor(F.lit(4)))
    return out["layers"].select("file_id", "layer", "entities")


@query("cad_skips", o.sql(
    """SELECT file_id, t AS type, count(*) AS skipped FROM (
      SELECT l_orderkey // 400 AS file_id, l_linenumber, ['LINE','LWPOLYLINE','CIRCLE','ARC','SPLINE','INSERT'][(l_orderkey + l_linenumber) % 6 + 1] AS t FROM lineitem)
    WHERE t = 'SPLINE' OR (t = 'INSERT' AND l_linenumber % 3 = 2) GROUP BY ALL"""))
def _(s):
    return cad.normalise(s.cad_entities, _blocks(s), cad.unit_factor(F.lit(4)))["skips"]


@query("cad_shapes")
def _(s):
    out = cad.normalise(s.cad_entities, _blocks(s), cad.unit_factor(F.lit(4)))["shapes"]
    return out.groupBy("file_id", "layer").agg(F.count("*").alias("shapes"), F.round(F.sum(g.polygon_area(F.col("polygon"))), 1).alias("area_m2"))


@query("svg_rooms", o.sql("SELECT building_id, unit_id AS name, x0, y0, x1, y1 FROM units"))
def _(s):
    b = g.bbox(F.col("polygon"))
    el = s.units.select(
        F.col("building_id").alias("file_id"), "pos",
        F.when(
            F.col("pos") % 2 == 0,
            F.concat(F.lit('<rect id="'), "unit_id", F.lit('" x="'), b["x0"], F.lit('" y="'), -b["y1"], F.lit('" width="'), b["x1"] - b["x0"], F.lit('" height="'), b["y1"] - b["y0"], F.lit('"/>')),
        ).otherwise(
            F.concat(F.lit('<path data-name="'), "unit_id", F.lit('" d="M '), b["x0"], F.lit(" "), -b["y1"], F.lit(" h "), b["x1"] - b["x0"], F.lit(" v "), b["y1"] - b["y0"],
                     F.lit(" L "), b["x0"], F.lit(" "), -b["y0"], F.lit(' Z"/>'))
        ).alias("el"))
    files = el.groupBy("file_id").agg(F.concat(F.lit("<svg>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "el"))), lambda v: v["el"]), "\n"), F.lit("</svg>")).alias("text"))
    p = g.bbox(F.col("points"))
    return svg.shapes(files).select(
        F.col("file_id").alias("building_id"), "name", p["x0"].alias("x0"), (-p["y1"] + 0.0).alias("y0"), p["x1"].alias("x1"), (-p["y0"] + 0.0).alias("y1"))


@query("security_report")
def _(s):
    rings = scene_rings(s)
    c = cov.coverage(s.units, s.footprints, rings)
    r = regions.blind_regions(s.units, s.footprints, rings)
    return report.report_lines(s.levels, s.units, s.cameras, stored(c, "coverage"), stored(r, "regions"), "2024-06-01T00:00:00Z")


@query("map_units", o.sql(
    """SELECT u.building_id, u.unit_id, CASE WHEN category = 'corridor' THEN 'circ' WHEN category IN ('stairs','elevator') THEN 'core' WHEN category = 'outside' THEN 'outside' ELSE 'gaming' END AS func,
    coalesce(names, '') AS occupant, coalesce(security, 'public') AS security, round(lng0 + x0 / (111320 * cos(radians(lat0))), 6) AS lng, round(lat0 + y0 / 111320, 6) AS lat
    FROM units u JOIN buildings b USING (building_id) LEFT JOIN (SELECT building_id, unit_id, string_agg(name, ' ' ORDER BY pos) AS names FROM occupants GROUP BY ALL) n USING (building_id, unit_id)"""))
def _(s):
    m = report.map_units(s.buildings, s.units, s.levels, s.occupants)
    p = F.get("ring", F.lit(0))
    return m.select("building_id", "unit_id", "func", "occupant", "security", F.round(F.get(p, F.lit(0)), 6).alias("lng"), F.round(F.get(p, F.lit(1)), 6).alias("lat"))


@query("model_ranges", o.sql(
    f"SELECT camera_id, round(least(60, floor({PX.format(d='1')} / 62 * 10 + 0.5) / 10), 3)::DOUBLE AS range_m FROM cameras WHERE mp IS NOT NULL"))
def _(s):
    return s.cameras.where("resolution_mp is not null").select(
        "camera_id", r3(optics.model_range_m(F.col("kind"), F.col("fov_deg"), F.col("resolution_mp")), "range_m"))
