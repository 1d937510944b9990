import json

import pytest
from pyspark.sql import functions as F

from floorlens.functions import geometry as g
from floorlens.operators import edits
from floorlens.sources import building_file as bf, cad, catalogue, documents, geojson, schedule, svg
from floorlens.streaming import live
from helpers import one, rect, units


def files(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id bigint, text string")


def test_schedules_are_split_once_a_file(spark, tmp_path):
    """One table file makes many tasks, and no filter repeats the header's parts."""
    files(spark, *["Name;No\n" + f"c{i};{i + 1}" for i in range(40)]).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = schedule.parse_schedules(spark.read.parquet(f"{tmp_path}/t"))["rows"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("split(") == 1
    assert {(r.name, r.op_number) for r in rows.collect()} == {(f"c{i}", i + 1) for i in range(40)}


def test_schedules(spark):
    comma = "Camera Name,Model,Ch,Mount Height (m),IP Address,Serial,Location\nLobby,Axis P3265-LVE,1,3,10.0.0.1,S1,Front\n\"Dock, \"\"B\"\"\",hikvision ds-2cd2087g2-lu v2,2,2.5,,,\n"
    semi = "﻿Name;Height;No\nA;12 ft;3.5\n;x;1\nB;3,5;-2\n"
    got = schedule.parse_schedules(files(spark, comma, semi, "foo,bar\n1,2", "name", "name,x\n,1"))
    rows = {(r.file_id, r.name): r for r in got["rows"].collect()}
    assert set(rows) == {(0, "Lobby"), (0, 'Dock, "B"'), (1, "A"), (1, "B")}
    assert rows[0, "Lobby"].spec.label == "Axis P3265-LVE" and rows[0, 'Dock, "B"'].spec.resolution_mp == 8
    assert rows[0, "Lobby"].op_number == 1 and rows[0, "Lobby"].notes == "Front" and rows[0, 'Dock, "B"'].ip_address is None
    assert rows[1, "A"].mount_m == pytest.approx(3.6576, abs=1e-4) and rows[1, "A"].op_number is None and rows[1, "B"].mount_m == 3.5
    info = {r.file_id: r for r in got["info"].collect()}
    assert info[1].skipped == 1 and info[1].delim == ";" and info[0].unmapped == []
    bad = {r.file_id: (r.reason, r.headers) for r in got["rejects"].collect()}
    assert bad[2] == ("no_name_column", ["foo", "bar"]) and bad[3][0] == "no_rows" and bad[4][0] == "no_named_rows"


def test_header_falls_through_to_a_free_field(spark):
    m = one(spark, schedule.map_headers(F.array(*[F.lit(h) for h in ["Name", "Camera", "No", "Channel", "Zone", "Room"]])))
    assert [(x.field, x.i) for x in m] == [("name", 0), ("op_number", 2), ("notes", 4)]


def test_model_ranges(spark):
    rows = catalogue.catalogue(spark).collect()
    assert len(rows) == 18 and all(0 < r.range_m <= 60 for r in rows)
    assert one(spark, catalogue.resolve_model(F.lit("  "))) is None


SVG = """<svg><rect id="r" x="0" y="0" width="10" height="5"/><rect width="0" height="4"/>
<polygon data-name="tri" points="0,0 4,0 4,4"/><path id='p' d="M0 0 h4 v4 h-4 z m10 10 l2 0 0 2 -2 0 z"/><path d="M0,0 C1,1 2,2 3,0 L3,3"/></svg>"""


def test_svg_shapes(spark):
    rows = svg.shapes(files(spark, SVG)).orderBy("seq", "sub").collect()
    got = [(r.name, [tuple(p) for p in r.points]) for r in rows]
    assert got[0] == ("r", [(0, 0), (10, 0), (10, 5), (0, 5)]) and got[1] == ("tri", [(0, 0), (4, 0), (4, 4)])
    assert got[2] == ("p", [(0, 0), (4, 0), (4, 4), (0, 4)]) and got[3] == ("p", [(10, 10), (12, 10), (12, 12), (10, 12)])
    assert got[4] == (None, [(0, 0), (3, 0), (3, 3)])


ENT = (
    f"file_id int, entity_id int, type string, layer string, vertices {g.RING}, closed boolean, center {g.POINT}, radius double, start_angle double, "
    f"end_angle double, block string, position {g.POINT}, x_scale double, y_scale double, rotation double"
)


def test_cad(spark):
    sq = [(0.0, 0.0), (2000.0, 0.0), (2000.0, 2000.0), (0.0, 2000.0)]
    n = [None] * 4
    e = spark.createDataFrame([
        (1, 1, "LWPOLYLINE", "W", sq, True, *n, None, None, None, None, None),
        (1, 2, "LWPOLYLINE", "W", sq + [sq[0]], False, *n, None, None, None, None, None),
        (1, 3, "LINE", "L", [(0.0, 0.0), (float("nan"), 1.0)], False, *n, None, None, None, None, None),
        (1, 4, "CIRCLE", "C", None, False, (5000.0, 5000.0), 1000.0, None, None, None, None, None, None, None),
        (1, 5, "ARC", "C", None, False, (5000.0, 5000.0), 1000.0, 0.0, 1.0, None, None, None, None, None),
        (1, 6, "SPLINE", "S", None, False, *n, None, None, None, None, None),
        (1, 7, "INSERT", "I", None, False, *n, "B", (1000.0, 0.0), 2.0, 1.0, 90.0),
        (1, 8, "INSERT", "I", None, False, *n, "nope", None, None, None, None),
    ], ENT)
    b = spark.createDataFrame([(1, "B", (0.0, 0.0), "LINE", "BL", [(0.0, 0.0), (500.0, 0.0)], False, None, None, None, None)],
        f"file_id int, block string, base {g.POINT}, b_type string, b_layer string, b_vertices {g.RING}, b_closed boolean, b_center {g.POINT}, b_radius double, b_start_angle double, b_end_angle double")
    out = cad.normalise(e, b, cad.unit_factor(F.lit(4)))
    assert {r.layer: r.entities for r in out["layers"].collect()} == {"W": 2, "C": 2, "BL": 1}
    assert {r.type: r.skipped for r in out["skips"].collect()} == {"LINE": 1, "SPLINE": 1, "INSERT": 1}
    shapes = out["shapes"].withColumn("a", g.polygon_area(F.col("polygon"))).collect()
    assert sorted(r.layer for r in shapes) == ["C", "W", "W"] and shapes and {round(r.a, 2) for r in shapes if r.layer == "W"} == {4.0}
    lo = out["lines"].select(F.min(g.bbox(F.col("points"))["x0"]), F.min(g.bbox(F.col("points"))["y0"])).first()
    assert tuple(lo) == (1.0, 1.0)
    lines = {r.entity_id: r.points for r in out["lines"].collect()}
    assert len(lines[4]) == 33 and len(lines[5]) == 33 and tuple(lines[7][1]) == pytest.approx((2.0, 2.0))
    assert one(spark, cad.units_guessed(F.lit(0))) and not one(spark, cad.units_guessed(F.lit(4)))


def doc(**kw):
    return {"origin": [1, 2], "levels": [], "units": [{"id": "u", "ordinal": 0, "name": "n", "category": "room", "polygon": [[0, 0], [1, 0], [1, 1]]}], "openings": [], "verticals": [], **kw}


def test_building_files(spark):
    env = lambda b, f=bf.FORMAT: json.dumps({"format": f, "version": 3, "propertyId": "p", "building": b})
    bad_unit = doc(units=[{"id": "u"}])
    texts = [json.dumps(doc()), env(doc()), env(doc(), "other"), "{oops", json.dumps(doc(origin=[1])), json.dumps(bad_unit)]
    p = bf.parse_files(files(spark, *texts))
    assert {r.file_id: r.ok for r in p.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}
    assert bf.units_table(p).count() == 2 and bf.collection(p, "cameras").count() == 0 and bf.rejects(p).count() == 4


def test_slugs(spark):
    names = spark.createDataFrame([(0, "Casino!"), (1, "casino"), (2, "  "), (3, "Casino"), (4, "New Site")], "seq bigint, name string")
    taken = spark.createDataFrame([("casino",), ("casino-3",)], "id string")
    got = {r.seq: r.id for r in bf.new_property_ids(names, taken).collect()}
    assert got == {0: "casino-2", 1: "casino-4", 2: "property", 3: "casino-5", 4: "new-site"}
    met = spark.createDataFrame(list(enumerate(["a", "a", "a-2", "a-2-2", "a", "b"])), "seq bigint, name string")
    ids = {r.seq: r.id for r in bf.new_property_ids(met, taken).collect()}
    assert ids == {0: "a", 1: "a-2", 2: "a-2-2", 3: "a-2-2-2", 4: "a-3", 5: "b"}


def test_quoted_cells(spark):
    lines = ['"Cam A","","",x', 'C1,"a, b,c,d', '"say ""hi""", "x"y ,z', ",,", '""""', "", '"a""']
    want = [["Cam A", "", "", "x"], ["C1", "a, b,c,d"], ['say "hi"', "xy", "z"], ["", "", ""], ['"'], [""], ['a"']]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    assert [r.c for r in df.select("i", schedule.split_cells(F.col("line"), ",").alias("c")).orderBy("i").collect()] == want


def test_two_edits_of_one_row(spark):
    occupants = spark.createDataFrame([(1, "o1", "u1", None)], f"building_id bigint, occupant_id string, unit_id string, anchor {g.POINT}")
    moves = spark.createDataFrame([(1, "o1", "u3", 1), (1, "o1", "u2", 2)], "building_id bigint, occupant_id string, unit_id string, seq int")
    assert [r.unit_id for r in edits.move_occupants(occupants, moves).collect()] == ["u2"]
    aim = "heading double, tilt_deg double, fov_deg double, range_m double"
    cams = spark.createDataFrame([(1, "c", 5.0, None, 90.0, 8.0)], f"building_id bigint, camera_id string, {aim}")
    presets = spark.createDataFrame([(1, "c", 3, "P", 7.0, 0.0, 60.0, 9.0)], f"building_id bigint, camera_id string, slot int, name string, {aim}")
    asks = spark.createDataFrame([(1, "c", "", i) for i in range(9)], "building_id bigint, camera_id string, name string, seq int")
    saved = edits.save_presets(cams, presets, asks)
    assert sorted(r.slot for r in saved.collect()) == [2, 3, 4, 5, 6, 7, 8, 9]
    calls = spark.createDataFrame([(1, "c", 3, 2), (1, "c", 2, 1), (1, "c", 8, 3)], "building_id bigint, camera_id string, slot int, seq int")
    assert [r.heading for r in edits.recall_presets(cams, presets, calls).collect()] == [7.0]
    column = spark.createDataFrame([(1, "s", None)], f"building_id bigint, structure_id string, polygon {g.RING}")
    turns = spark.createDataFrame([(1, "s", (0.0, 0.0), 1.0, 1), (1, "s", (9.0, 0.0), 1.0, 2)], f"building_id bigint, structure_id string, center {g.POINT}, radius_m double, seq int")
    (ring,) = [r.polygon for r in edits.round_column(column, turns).collect()]
    assert min(p.x for p in ring) > 7
    model = spark.createDataFrame([("M2", 70.0, 8.0, 20.0), ("M1", 60.0, 4.0, 10.0)], "label string, fov_deg double, resolution_mp double, range_m double")
    bare = spark.createDataFrame([(1, 0, "c", "fixed", None, 90.0, None, 8.0), (1, 0, "d", "dome", None, 90.0, None, 8.0)], "building_id bigint, ordinal int, camera_id string, kind string, model string, fov_deg double, resolution_mp double, range_m double")
    filled = {r.camera_id: r.model for r in edits.fill_unrated(bare, bare, "fixed", model).collect()}
    assert filled == {"c": "M1", "d": None}
    assert {r.model for r in edits.fill_unrated(bare, bare, "fixed", model.where("false")).collect()} == {None}


def test_saved_choice_and_registry(spark):
    saves = spark.createDataFrame([(None, "x"), ("b", "y")], "property_id string, doc string")
    assert bf.migrate_legacy(saves, "a").count() == 3 and bf.migrate_legacy(saves, "b").count() == 2
    reg = bf.read_properties(spark.createDataFrame([('[{"id":"a","name":"A"},{"id":"b"},7]',)], "text string"))
    assert reg.count() <= 1


def test_geojson_reader_rules(spark):
    f = {"type": "FeatureCollection", "floorlens": {"origin": [10, 20]}, "features": [
        {"id": "u", "properties": {"feature_type": "unit", "category": "weird", "ordinal": 1}, "geometry": {"type": "Polygon", "coordinates": [[[10, 20], [10.001, 20], [10.001, 20.001], [10, 20]]]}},
        {"id": "o1", "properties": {"floorlens:type": "occupant", "unit": "u"}, "geometry": None},
        {"id": "o2", "properties": {"floorlens:type": "occupant", "unit": "ghost"}, "geometry": None},
        {"id": "c", "properties": {"floorlens:type": "camera", "ordinal": 1}, "geometry": {"type": "Point", "coordinates": [10, 20]}}]}
    t = geojson.read_documents(files(spark, json.dumps(f), json.dumps({"features": []}), "junk"))
    u = t["units"].first()
    assert u.category == "room" and len(u.polygon) == 3 and u.ordinal == 1 and u.name == "Unit"
    assert [r.occupant_id for r in t["occupants"].collect()] == ["o1"]
    c = t["cameras"].first()
    assert (c.fov_deg, c.range_m, c.kind) == (90, 8, "fixed")
    assert sorted(r.file_id for r in t["rejects"].collect()) == [1, 2]


def test_small_edits(spark):
    r = F.array(*[g.pt(x, y) for x, y in rect(0, 0, 2, 2)])
    pts = lambda c: [tuple(p) for p in one(spark, c)]
    assert pts(edits.move_vertex(r, 0, g.pt(9, 9)))[0] == (9, 9) and len(pts(edits.delete_vertex(r, 1))) == 3
    assert pts(edits.insert_vertex(r, F.lit(0), g.pt(1, 0)))[1] == (1, 0)
    ids = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, edits.view_move(ids, F.lit("b"), -1)) == ["b", "a", "c"] and one(spark, edits.view_move(ids, F.lit("a"), -1)) == ["a", "b", "c"]
    assert one(spark, edits.view_add(ids, F.lit("a"))) == ["a", "b", "c"]
    u = units(spark, [("h", "corridor", rect(0, 10, 30, 14)), ("a", "room", rect(0, 0, 10, 10))])
    o = spark.createDataFrame([], "building_id bigint, opening_id string, unit_id string, at struct<x:double,y:double>")
    new = units(spark, [("n", "office", rect(10, 0, 20, 10))]).drop("name", "security")
    out = edits.add_rooms(new, u, o)
    assert out["units"].where("unit_id = 'n'").first().name == "Office 1" and tuple(out["openings"].first().at) == (15, 10)
    v = spark.createDataFrame([], "building_id bigint, pos int, unit_a string, unit_b string, name string")
    up = units(spark, [("t", "room", rect(0, 0, 10, 10), "T", None, 1)])
    links = spark.createDataFrame([(1, 0, "a", "t", "Stairs"), (1, 1, "t", "a", "Stairs"), (1, 2, "a", "h", "Stairs")], v.schema)
    both = edits.link_floors(links, u.unionByName(up), v)
    assert both["verticals"].count() == 1 and both["units"].where("category = 'stairs'").count() == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "2024-01-01 00:00:00", 0, ["a", "b"]), (1, "2024-01-01 00:00:05", 1, ["b", "a"]), (1, "2024-01-01 00:00:09", 2, ["b"]), (2, "2024-01-01 00:00:01", 3, [])]
    df = spark.createDataFrame(rows, "subject bigint, t string, probe_id bigint, cams array<string>").select("subject", F.to_timestamp("t").alias("ts"), "probe_id", "cams")
    # newest first, and a last row that lets the watermark pass the others
    df.orderBy(F.desc("ts")).coalesce(1).write.parquet(str(src))
    last = spark.createDataFrame([(9, "2024-01-01 02:00:00", 9, ["z"])], "subject bigint, t string, probe_id bigint, cams array<string>")
    last.select("subject", F.to_timestamp("t").alias("ts"), "probe_id", "cams").write.mode("append").parquet(str(src))
    q = (live.follow_subjects(live.fix_stream(spark, str(src), df.schema)).writeStream.format("memory").queryName("follow")
         .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(60)
    assert {r.probe_id: r.camera_id for r in spark.table("follow").collect()} == {0: "a", 1: "a", 2: "b", 3: None}


def test_saves_keep_every_collection_and_field(spark, tmp_path):
    """All 16 collections, written to files and read back from their folder."""
    p, r = (1.5, -2.0), [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    aim = "heading double, tilt_deg double, fov_deg double, range_m double"
    given = {
        "levels": ("ordinal int, name string, ceiling_m double", [(1, 0, "Ground \"G\"", 4.5), (1, 1, "Upper", None), (2, 0, "Only", None)]),
        "units": (f"ordinal int, unit_id string, pos int, name string, category string, security string, polygon {g.RING}", [(1, 0, "u2", 0, "B", "room", None, r), (1, 0, "u1", 1, "Ä,\n[x]", "retail", "secure", r)]),
        "openings": (f"opening_id string, pos int, unit_id string, at {g.POINT}, kind string, style string, width_m double, height_m double", [(1, "d", 0, "u1", p, None, "glass", 1.2, None)]),
        "verticals": ("pos int, unit_a string, unit_b string, name string", [(1, 0, "u1", "u2", "Stairs")]),
        "cameras": (f"ordinal int, camera_id string, pos int, at {g.POINT}, {aim}, kind string, name string, mount_m double, vfov_deg double, roll_deg double, mount string, op_number int, status string, model string, serial string, ip_address string, stream_ref string, resolution_mp double, installed_on string, last_serviced_on string, notes string", [
            (1, 0, "c", 0, p, 10.0, 30.0, 90.0, 8.0, "ptz", "Cam", 3.0, 40.0, 1.0, "wall", 7, "online", "M", "S", "10.0.0.1", "rtsp://x", 8.0, "2024-01-02", None, "n"),
            (1, 0, "b", 1, p, 0.0, None, 60.0, 9.0, "fixed", "Cam 2", *[None] * 14)]),
        "camera_presets": (f"camera_id string, slot int, name string, {aim}", [(1, "c", 2, "Gate", 5.0, 0.0, 60.0, 9.0), (1, "c", 1, "Home", 10.0, 30.0, 90.0, 8.0)]),
        "incidents": (f"ordinal int, incident_id string, at {g.POINT}, kind string, note string", [(1, 0, "i", p, "theft", "seen")]),
        "patrols": (f"ordinal int, patrol_id string, name string, points {g.RING}", [(1, 0, "pt", "Round", r)]),
        "amenities": (f"ordinal int, amenity_id string, pos int, at {g.POINT}, kind string, name string", [(1, 0, "a", 0, p, "atm", None)]),
        "fixtures": (f"ordinal int, fixture_id string, pos int, kind string, polygon {g.RING}", [(1, 0, "f", 0, "table", r)]),
        "footprints": (f"ordinal int, pos int, polygon {g.RING}", [(1, 0, 0, r), (1, 1, 0, r), (1, 1, 0, r)]),
        "structures": (f"ordinal int, structure_id string, pos int, kind string, polygon {g.RING}, height_m double, base_m double", [(1, 0, "s", 0, "column", r, None, 2.5)]),
        "voids": (f"ordinal int, void_id string, polygon {g.RING}", [(1, 1, "v", r)]),
        "occupants": (f"occupant_id string, pos int, unit_id string, name string, category string, hours string, phone string, website string, anchor {g.POINT}", [(1, "o", 0, "u1", "Shop", "retail", "9-17", "1", "w", p), (1, "q", 1, "u2", "Bar", None, None, None, None, None)]),
        "vector_underlays": (f"ordinal int, pos int, name string, polylines array<{g.RING}>, opacity double", [(1, 0, 0, "cad", [r, r[:2]], 0.5)]),
        "underlays": (f"ordinal int, data_url string, natural_w double, natural_h double, width_m double, offset {g.POINT}, rotation double, opacity double", [(1, 0, "", 10.0, 20.0, 30.0, p, 0.0, 0.5)]),
        "camera_views": ("pos int, view_id string, name string, camera_ids array<string>", [(1, 0, "w", "Wall", ["c", "b"])]),
    }
    tables = {n: spark.createDataFrame(rows, f"building_id bigint, {schema}") for n, (schema, rows) in given.items()}
    dated = {c: F.col(c).cast("date") for c in ("installed_on", "last_serviced_on")}
    tables["cameras"] = tables["cameras"].withColumns(dated)
    buildings = spark.createDataFrame([(1, 8.5, 47.25, 3), (2, 0.0, 1.0, None)], "building_id bigint, origin_lng double, origin_lat double, rev int")
    path = str(tmp_path / "saves")
    bf.write_saves(buildings, tables, path)
    files = [f for f in (tmp_path / "saves").rglob("*.txt")]
    docs = {json.loads(f.read_text())["propertyId"]: json.loads(f.read_text()) for f in files}
    assert set(docs) == {"b1", "b2"} and len(files) == 2
    assert docs["b1"]["building"]["origin"] == [8.5, 47.25] and docs["b1"]["building"]["demoRev"] == 3 and "demoRev" not in docs["b2"]["building"]
    assert "security" not in docs["b1"]["building"]["units"][0] and docs["b2"]["building"]["units"] == []
    parsed = bf.read_saves(spark, path)
    assert parsed.where("ok").count() == 2
    back = bf.tables(parsed)
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "pos"]
        assert sorted(map(str, back[name].select(columns).collect())) == sorted(map(str, df.select(columns).collect())), name
    assert [r.unit_id for r in back["units"].orderBy("pos").collect()] == ["u2", "u1"]


def test_documents_are_read_from_folders(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("Camera Name,Ch\nLobby,1\n")
    (tmp_path / "in" / "deep" / "b.csv").write_text("Name;No\nDock;2\n")
    (tmp_path / "in" / "c.svg").write_text(SVG)
    rows = schedule.parse_schedules(documents.read(spark, str(tmp_path / "in"), "*.csv"))["rows"].collect()
    assert {(r.file_id.rsplit("/", 1)[1], r.name, r.op_number) for r in rows} == {("a.csv", "Lobby", 1), ("b.csv", "Dock", 2)}
    assert svg.shapes(documents.read(spark, str(tmp_path / "in"), "*.svg")).count() == 5


def test_cad_files_are_spread_before_they_are_drawn(spark):
    """A stored table of one file would else be drawn in one task."""
    e = spark.createDataFrame([], "file_id long, entity_id long, type string, layer string, vertices array<struct<x:double,y:double>>, closed boolean, center struct<x:double,y:double>, radius double, start_angle double, end_angle double, block string, position struct<x:double,y:double>, x_scale double, y_scale double, rotation double")
    b = e.select("file_id", "block", F.col("center").alias("base"), *[F.col(c).alias(f"b_{c}") for c in ("type", "layer", "vertices", "closed", "center", "radius", "start_angle", "end_angle")])
    shapes = cad.normalise(e, b)["shapes"]
    assert "RepartitionByExpression" in shapes._jdf.queryExecution().analyzed().toString() and shapes.count() == 0


def test_saves_are_parsed_once_and_dealt_once(spark, tmp_path):
    """Collections come from stored parses, and the lines of a file cross one shuffle; entities that tie keep their commas."""
    buildings = spark.createDataFrame([(i, 8.5, 47.25, 3) for i in range(20)], "building_id bigint, origin_lng double, origin_lat double, rev int")
    floors = buildings.selectExpr("building_id", "explode(array(0, 0, 0)) AS ordinal", "uuid() AS name", "2.5D AS ceiling_m")
    lines = bf.save_lines(buildings, {"levels": floors}).sortWithinPartitions("building_id", *bf.ORDER)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(building_id") == 1 and lines.rdd.getNumPartitions() >= 4
    bf.write_saves(buildings, {"levels": floors}, f"{tmp_path}/saves")
    parsed = bf.read_saves(spark, f"{tmp_path}/saves")
    assert parsed.where("ok").count() == 20 and bf.rejects(parsed).count() == 0
    levels = bf.tables(parsed)["levels"]
    assert "from_json" not in levels._jdf.queryExecution().optimizedPlan().toString() and levels.count() == 60


def test_saves_are_parsed_by_one_schema(spark, tmp_path):
    """A file is read either as an envelope or bare, and rejects keep their text."""
    env = json.dumps({"format": bf.FORMAT, "propertyId": "p", "building": doc()})
    for i, text in enumerate([env, json.dumps(doc()), "{oops", json.dumps({"format": "other", "propertyId": "q", "building": doc()})]):
        (tmp_path / f"building_id={i}").mkdir()
        (tmp_path / f"building_id={i}" / "a.txt").write_text(text)
    got = {r.file_id: r for r in bf.read_saves(spark, str(tmp_path)).collect()}
    assert {k: (r.ok, r.property_id) for k, r in got.items()} == {0: (True, "p"), 1: (True, None), 2: (False, None), 3: (False, "q")}
    assert got[2].text == "{oops" and [u.id for u in got[1].building.units] == ["u"]
