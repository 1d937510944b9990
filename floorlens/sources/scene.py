"""A portfolio of buildings derived from the star-schema test tables.

Parts become rooms, customers become cameras and route requests, events become
position fixes, orders become edits, suppliers become columns and amenities.
The portfolio grows by number of buildings with the tables it is read from.
Coordinates are multiples of 1/16 m.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as g
from .catalogue import CAMERA_MODELS

CATS = ["room", "office", "restroom", "lobby", "retail", "storage", "mechanical", "room"]
FIXTURES = [
    "blackjack", "roulette", "poker", "baccarat", "slot", "bar", "counter",
    "seating", "stage", "planter", "parking", "car", "craps", "unknown",
]
AMENITIES = [
    "restroom", "atm", "exit", "info", "firstaid",
    "ticketing", "dining", "bar", "coatcheck", "smoking",
]
INCIDENTS = ["trespass", "theft", "vandalism", "medical", "hazard", "alarm", "other"]
STATUSES = ["online", "offline", "fault", "planned"]


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _key(col: str):
    return F.col(col).cast("bigint")


class Scene:
    """Lazily built entity tables; every attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _last_part(self):
        """Largest part key, as a scalar subquery (no driver round trip)."""
        return self.table("part").select(F.max("p_partkey")).scalar()

    @cached_property
    def _nb(self):
        return F.floor(self._last_part / 60) + 1

    @cached_property
    def _rooms(self) -> DataFrame:
        k = _key("p_partkey")
        return self.table("part").select(
            k.alias("k"),
            F.floor(k / 60).alias("building_id"),
            F.floor(k % 60 / 20).cast("int").alias("ordinal"),
            (k % 20).alias("slot"),
            (k % 60).cast("int").alias("pos"),
            (F.floor(k % 20 / 2) * 6).cast("double").alias("x0"),
            (k % 2 * 8).cast("double").alias("y0"),
            F.col("p_size"),
            F.col("p_name"),
            F.col("p_brand"),
            F.col("p_type"),
        )

    @cached_property
    def floors(self) -> DataFrame:
        """Floors that have units."""
        return self._rooms.select("building_id", "ordinal").distinct()

    def _on_floors(self, df: DataFrame) -> DataFrame:
        return df.join(self.floors, ["building_id", "ordinal"], "left_semi")

    @cached_property
    def buildings(self) -> DataFrame:
        b = self._rooms.select("building_id").distinct()
        n = F.col("building_id") % 25
        return b.select(
            "building_id",
            n.cast("int").alias("nation_key"),
            (n - 120).cast("double").alias("origin_lng"),
            (n / 2 + 30).alias("origin_lat"),
            F.when(F.col("building_id") % 3 == 0, F.lit(2)).alias("rev"),
            F.lit("Mon-Fri 9-18").alias("site_hours"),
        )

    @cached_property
    def levels(self) -> DataFrame:
        o = F.col("ordinal")
        return self.floors.select(
            "building_id",
            "ordinal",
            F.concat(F.lit("Level "), o).alias("name"),
            F.when(o == 0, F.lit(4.5)).when(o == 2, F.lit(2.8)).alias("ceiling_m"),
        )

    @cached_property
    def units(self) -> DataFrame:
        r = self._rooms
        x0, y0, s = F.col("x0"), F.col("y0"), F.col("p_size")
        rooms = r.select(
            "building_id",
            "ordinal",
            F.concat(F.lit("u"), "k").alias("unit_id"),
            "pos",
            F.when(s == 50, "").otherwise(F.col("p_name")).alias("name"),
            F.when(F.col("slot") == 18, "stairs")
            .when(F.col("slot") == 19, "elevator")
            .otherwise(_pick(CATS, s))
            .alias("category"),
            F.when(s % 17 == 0, "restricted").when(s % 5 == 0, "secure").alias("security"),
            g.rect_poly(x0, y0, x0 + 6, y0 + 5).alias("polygon"),
        )
        halls = self.floors.select(
            "building_id",
            "ordinal",
            F.concat(F.lit("c"), "building_id", F.lit("-"), "ordinal").alias("unit_id"),
            (F.col("ordinal") + 60).alias("pos"),
            F.lit("Hall").alias("name"),
            F.lit("corridor").alias("category"),
            F.lit(None).cast("string").alias("security"),
            g.rect_poly(0, 5, 60, 8).alias("polygon"),
        )
        yards = self.floors.where("ordinal = 0").select(
            "building_id",
            "ordinal",
            F.concat(F.lit("out"), "building_id").alias("unit_id"),
            F.lit(63).alias("pos"),
            F.lit("Yard").alias("name"),
            F.lit("outside").alias("category"),
            F.lit(None).cast("string").alias("security"),
            g.rect_poly(0, -8, 60, -2).alias("polygon"),
        )
        return rooms.unionByName(halls).unionByName(yards)

    @cached_property
    def footprints(self) -> DataFrame:
        return self.floors.select(
            "building_id", "ordinal", F.lit(0).alias("pos"), g.rect_poly(0, 0, 60, 13).alias("polygon")
        )

    @cached_property
    def openings(self) -> DataFrame:
        none = lambda t: F.lit(None).cast(t)
        doors = self._rooms.where("p_size % 13 != 0").select(
            "building_id",
            F.concat(F.lit("d"), "k").alias("opening_id"),
            "pos",
            F.concat(F.lit("u"), "k").alias("unit_id"),
            g.pt(F.col("x0") + 3, F.when(F.col("y0") == 0, 5.0).otherwise(8.0)).alias("at"),
            none("string").alias("kind"),
            none("string").alias("style"),
            none("double").alias("width_m"),
            none("double").alias("height_m"),
        )
        entrances = self._rooms.where("slot = 0 and ordinal = 0").select(
            "building_id",
            F.concat(F.lit("e"), "k").alias("opening_id"),
            F.lit(60).alias("pos"),
            F.concat(F.lit("u"), "k").alias("unit_id"),
            g.pt(3, 0).alias("at"),
            F.lit("entrance").alias("kind"),
            none("string").alias("style"),
            none("double").alias("width_m"),
            none("double").alias("height_m"),
        )
        return doors.unionByName(entrances)

    @cached_property
    def verticals(self) -> DataFrame:
        return self._rooms.where("slot >= 18 and ordinal < 2").where(
            F.col("k") + 20 <= self._last_part
        ).select(
            "building_id",
            (F.col("ordinal") * 2 + F.col("slot") - 18).cast("int").alias("pos"),
            F.concat(F.lit("u"), "k").alias("unit_a"),
            F.concat(F.lit("u"), F.col("k") + 20).alias("unit_b"),
            F.when(F.col("slot") == 18, "Stairs").otherwise("Elevator").alias("name"),
        )

    @cached_property
    def cameras(self) -> DataFrame:
        k = F.col("k")
        base = self.table("customer").select(_key("c_custkey").alias("k"), "c_name").withColumn(
            "nb", self._nb
        )
        has_model = k % 3 == 0
        label = [f"{m[0]} {m[1]}" for m in CAMERA_MODELS]
        kind = (
            F.when(k % 5 == 0, "dome").when(k % 5 == 1, "ptz").otherwise("fixed")
        )
        fov = F.when(k % 5 == 0, 360.0).when(k % 5 == 1, 60.0).otherwise(
            (k % 5 * 5 + 90).cast("double")
        )
        status = F.when(k % 5 < 4, _pick(STATUSES, k % 5))
        cams = base.select(
            (k % F.col("nb")).alias("building_id"),
            (F.floor(k / F.col("nb")) % 3).cast("int").alias("ordinal"),
            F.concat(F.lit("cam"), k).alias("camera_id"),
            k.cast("int").alias("pos"),
            g.pt(k * 37 % 473 / 8.0 + 0.4375, k * 11 % 99 / 8.0 + 0.3125).alias("at"),
            (k * 45 % 360).cast("double").alias("heading"),
            fov.alias("fov_deg"),
            (k % 13 + 8).cast("double").alias("range_m"),
            kind.alias("kind"),
            F.col("c_name").alias("name"),
            F.when((k % 7 == 3) & (k % 5 != 0), (k % 30 + 20).cast("double")).alias("tilt_deg"),
            F.when(k % 7 == 3, F.lit(3.0)).alias("mount_m"),
            F.lit(None).cast("double").alias("vfov_deg"),
            F.lit(None).cast("double").alias("roll_deg"),
            F.lit(None).cast("string").alias("mount"),
            F.when(has_model, _pick([float(m[4]) for m in CAMERA_MODELS], k)).alias("resolution_mp"),
            F.when(k % 4 == 0, (k + 1).cast("int")).alias("op_number"),
            F.when(has_model, _pick(label, k)).alias("model"),
            status.alias("status"),
            F.when(k % 2 == 0, F.concat(F.lit("SN"), k)).alias("serial"),
            F.concat(F.lit("10.0."), k % 250, F.lit("."), k % 200).alias("ip_address"),
            F.when(k % 2 == 1, F.concat(F.lit("rtsp://nvr/"), k)).alias("stream_ref"),
            F.date_add(F.lit("2022-01-01").cast("date"), (k % 500).cast("int")).alias("installed_on"),
            F.when(
                k % 3 != 2, F.date_add(F.lit("2023-01-01").cast("date"), (k % 365).cast("int"))
            ).alias("last_serviced_on"),
            F.lit(None).cast("string").alias("notes"),
        )
        return self._on_floors(cams)

    @cached_property
    def camera_presets(self) -> DataFrame:
        c = self.cameras.where("kind = 'ptz'")
        rows = c.withColumn(
            "p",
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.lit(1).alias("slot"), F.lit("Home").alias("pname"), F.lit(0.0).alias("turn")),
                        F.struct(
                            (F.col("pos") % 8 + 2).alias("slot"),
                            F.lit("Gate").alias("pname"),
                            F.lit(30.0).alias("turn"),
                        ),
                    ),
                    lambda p: (p["slot"] > 1) | (F.col("pos") % 2 == 0),
                )
            ),
        )
        return rows.select(
            "building_id",
            "camera_id",
            F.col("p.slot").alias("slot"),
            F.col("p.pname").alias("name"),
            (F.col("heading") + F.col("p.turn")).alias("heading"),
            F.coalesce("tilt_deg", F.lit(0.0)).alias("tilt_deg"),
            "fov_deg",
            "range_m",
        )

    @cached_property
    def camera_views(self) -> DataFrame:
        k = F.col("pos")
        return self.cameras.where("pos % 10 = 0").select(
            "building_id",
            "ordinal",
            F.concat(F.lit("v"), k).alias("view_id"),
            k.alias("pos"),
            F.concat(F.lit("View "), k).alias("name"),
            F.array(
                *[F.concat(F.lit("cam"), k + self._nb * i) for i in (3, 0, 1, 6)]
            ).alias("camera_ids"),
        )

    @cached_property
    def occupants(self) -> DataFrame:
        kinds = {
            "ECONOMY": "retail", "LARGE": "dining", "MEDIUM": "services",
            "PROMO": "entertainment", "SMALL": "health", "STANDARD": "office",
        }
        cat = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])
        x0, y0 = F.col("x0"), F.col("y0")
        return self._rooms.where("p_size % 3 = 0 and slot < 18").select(
            "building_id",
            F.concat(F.lit("o"), "k").alias("occupant_id"),
            "pos",
            F.concat(F.lit("u"), "k").alias("unit_id"),
            F.col("p_brand").alias("name"),
            F.try_element_at(cat, F.col("p_type")).alias("category"),
            F.when(F.col("k") % 2 == 0, "9-17").alias("hours"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("string").alias("website"),
            F.when(F.col("k") % 4 == 0, g.pt(x0 + 1, y0 + 1)).alias("anchor"),
        )

    @cached_property
    def _suppliers(self) -> DataFrame:
        k = F.col("k")
        s = self.table("supplier").select(_key("s_suppkey").alias("k")).withColumn("nb", self._nb)
        return self._on_floors(
            s.select(
                "k",
                (k % F.col("nb")).alias("building_id"),
                (F.floor(k / F.col("nb")) % 3).cast("int").alias("ordinal"),
            )
        )

    @cached_property
    def structures(self) -> DataFrame:
        k = F.col("k")
        x = (k * 7 % 51 + 4).cast("double") + 0.5
        return self._suppliers.select(
            "building_id",
            "ordinal",
            F.concat(F.lit("s"), k).alias("structure_id"),
            k.cast("int").alias("pos"),
            F.when(k % 3 == 0, "obstacle").otherwise("column").alias("kind"),
            g.rect_poly(x - 0.25, 6.25, x + 0.25, 6.75).alias("polygon"),
            F.when(k % 5 == 0, F.lit(6.0)).when(k % 5 == 1, F.lit(2.0)).alias("height_m"),
            F.when(k % 4 == 0, F.lit(2.5)).alias("base_m"),
        )

    @cached_property
    def amenities(self) -> DataFrame:
        k = F.col("k")
        return self._suppliers.select(
            "building_id",
            "ordinal",
            F.concat(F.lit("a"), k).alias("amenity_id"),
            k.cast("int").alias("pos"),
            g.pt((k * 13 % 60).cast("double") + 0.5, (k * 5 % 13).cast("double") + 0.5).alias("at"),
            _pick(AMENITIES, k).alias("kind"),
            F.when(k % 2 == 0, F.concat(F.lit("Amenity "), k)).alias("name"),
        )

    @cached_property
    def fixtures(self) -> DataFrame:
        x0, y0 = F.col("x0"), F.col("y0")
        return self._rooms.where("p_size % 4 = 0").select(
            "building_id",
            "ordinal",
            F.concat(F.lit("f"), "k").alias("fixture_id"),
            "pos",
            _pick(FIXTURES, F.col("p_size")).alias("kind"),
            g.rect_poly(x0 + 1, y0 + 1, x0 + 3, y0 + 2).alias("polygon"),
        )

    @cached_property
    def voids(self) -> DataFrame:
        return self.floors.where("ordinal > 0 and building_id % 2 = 0").select(
            "building_id",
            "ordinal",
            F.concat(F.lit("v"), "building_id", F.lit("-"), "ordinal").alias("void_id"),
            F.lit(0).alias("pos"),
            g.rect_poly(20, 5, 26, 8).alias("polygon"),
        )

    @cached_property
    def probes(self) -> DataFrame:
        e = F.col("event_id")
        ev = self.table("events").select("event_id", "ts", "user_id", "event_type").withColumn(
            "nb", self._nb
        )
        return self._on_floors(
            ev.select(
                (F.col("user_id") % F.col("nb")).alias("building_id"),
                (e % 3).cast("int").alias("ordinal"),
                e.alias("probe_id"),
                F.col("user_id").alias("subject"),
                F.col("ts").cast("timestamp").alias("ts"),
                "event_type",
                g.pt(e * 7919 % 477 / 8.0 + 0.1875, e * 104729 % 103 / 8.0 + 0.0625).alias("at"),
            )
        )

    @cached_property
    def incidents(self) -> DataFrame:
        return self.probes.where("event_type = 'error'").select(
            "building_id",
            "ordinal",
            F.concat(F.lit("i"), "probe_id").alias("incident_id"),
            "ts",
            "at",
            _pick(INCIDENTS, F.col("probe_id")).alias("kind"),
        )

    @cached_property
    def patrols(self) -> DataFrame:
        return self.floors.select(
            "building_id",
            "ordinal",
            F.concat(F.lit("pt"), "building_id", F.lit("-"), "ordinal").alias("patrol_id"),
            F.lit("Round").alias("name"),
            F.array(g.pt(1, 6.5), g.pt(59, 6.5)).alias("points"),
        )

    @cached_property
    def routes(self) -> DataFrame:
        """One request per customer between two units of its building."""
        k, b = F.col("k"), F.col("building_id")
        req = self.table("customer").select(_key("c_custkey").alias("k")).select(
            k.alias("request_id"), (k % self._nb).alias("building_id"), k
        )
        start, goal = b * 60 + k * 7 % 60, b * 60 + (k * 13 + 5) % 60
        last = self._last_part
        return req.where((start <= last) & (goal <= last)).select(
            "request_id",
            "building_id",
            F.concat(F.lit("u"), start).alias("start_id"),
            F.concat(F.lit("u"), goal).alias("goal_id"),
        )

    @cached_property
    def edits(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_orderkey").alias("seq"),
            F.col("o_orderpriority").alias("edit_key"),
        )

    @cached_property
    def cad_entities(self) -> DataFrame:
        """CAD entities drawn from line items, one drawing per order group."""
        k = F.col("l_orderkey")
        n = F.col("l_linenumber")
        x = (k % 50).cast("double") * 1000
        y = (n * 7 % 40).cast("double") * 1000
        q = F.col("l_quantity").cast("double") * 100
        kind = _pick(["LINE", "LWPOLYLINE", "CIRCLE", "ARC", "SPLINE", "INSERT"], k + n)
        li = self.table("lineitem")
        return li.select(
            F.floor(k / 400).alias("file_id"),
            (k * 10 + n).alias("entity_id"),
            kind.alias("type"),
            F.when(n % 4 == 0, "A-DOOR").otherwise(F.col("l_returnflag")).alias("layer"),
            F.when(kind == "LINE", F.array(g.pt(x, y), g.pt(x + q, y)))
            .when(
                kind == "LWPOLYLINE",
                F.array(g.pt(x, y), g.pt(x + q, y), g.pt(x + q, y + q), g.pt(x, y + q)),
            )
            .alias("vertices"),
            (F.col("l_linestatus") == "O").alias("closed"),
            F.when(kind.isin("CIRCLE", "ARC"), g.pt(x, y)).alias("center"),
            F.when(kind.isin("CIRCLE", "ARC"), q).alias("radius"),
            F.when(kind == "ARC", F.lit(0.5)).alias("start_angle"),
            F.when(kind == "ARC", F.lit(2.0)).alias("end_angle"),
            F.when(kind == "INSERT", F.concat(F.lit("B"), n % 3)).alias("block"),
            F.when(kind == "INSERT", g.pt(x, y)).alias("position"),
            F.when(kind == "INSERT", F.lit(2.0)).alias("x_scale"),
            F.when(kind == "INSERT", F.lit(1.0)).alias("y_scale"),
            F.when(kind == "INSERT", F.lit(90.0)).alias("rotation"),
        )

    @cached_property
    def customer_names(self) -> DataFrame:
        return self.table("customer").select(_key("c_custkey").alias("seq"), F.col("c_mktsegment").alias("name"))

    @cached_property
    def schedule_files(self) -> DataFrame:
        """One small camera schedule per customer, with the quirks of
        spreadsheet exports: byte order mark, quotes, feet, blank rows."""
        k = F.col("c_custkey")
        label = _pick([f"{m[0]} {m[1]} Mk II" for m in CAMERA_MODELS], k)
        line = F.concat(
            F.lit('"'), "c_name", F.lit('";'), F.when(k % 3 == 0, label).otherwise("Unknown"), F.lit(";"),
            k + 1, F.lit(";"), k % 12 + 1, F.lit(" ft"),
        )
        text = F.concat(
            F.lit("\ufeffCamera Name;Model;Ch;Mount Height (m)\r\n"), line, F.lit("\r\n\r\n;nameless;;\r\n")
        )
        return self.table("customer").select(k.alias("file_id"), text.alias("text"))
