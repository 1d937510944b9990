"""Navigation graph of every building: units, doors, entrances, verticals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as g, labels
from ..operators.spatial import FLOOR
from ..session import cut

VERTICAL_COST = 6.0


def is_step_free(name, cat_a, cat_b):
    """Neither named like stairs or an escalator nor ending in a stairs unit."""
    by_name = F.coalesce(name, F.lit("")).rlike(r"(?i)\bstair|(?i)escalator")
    stairs = F.coalesce(cat_a == "stairs", F.lit(False)) | F.coalesce(cat_b == "stairs", F.lit(False))
    return ~by_name & ~stairs


def _places(units: DataFrame) -> DataFrame:
    """Units reduced to what the graph needs, centroids worked out once."""
    return cut(
        units.select(
            *FLOOR, "unit_id", "pos", "name", "category", "security",
            g.polygon_centroid(F.col("polygon")).alias("xy"),
        )
    )


def _unit_nodes(spots: DataFrame) -> DataFrame:
    return spots.where(~labels.is_non_routable(F.col("security"))).select(
        *FLOOR, F.col("unit_id").alias("node"), "xy", F.lit("unit").alias("kind"), "name", "category"
    )


def _door_links(spots: DataFrame, openings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Openings with their owner and hub (NULL hub: nothing to connect to):
    doors lead to the floor's first corridor, entrances to the nearest
    outside unit."""
    own = spots.select(
        *FLOOR, "unit_id", "category", "security", F.col("xy").alias("owner_xy"), F.lit(True).alias("known")
    )
    op = openings.select(
        "building_id", "opening_id", "pos", "unit_id", "at",
        (F.coalesce("kind", F.lit("door")) == "entrance").alias("is_entrance"),
    ).join(own, ["building_id", "unit_id"], "left")
    live = op.where("known and coalesce(security, '') != 'restricted'").where(
        "is_entrance or category != 'outside'"
    )
    hub = F.struct("unit_id", "xy", "security")
    hall = (
        spots.where("category = 'corridor'").groupBy(*FLOOR).agg(F.min_by(hub, "pos").alias("hub"))
    )
    doors = live.where("not is_entrance").join(hall, FLOOR, "left")
    yards = spots.where("category = 'outside'").select(*FLOOR, F.col("pos").alias("hub_pos"), hub.alias("hub"))
    entries = live.where("is_entrance")
    nearest = (
        entries.join(yards, FLOOR)
        .groupBy("building_id", "opening_id")
        .agg(F.min_by("hub", F.struct(g.dist(F.col("at"), F.col("hub.xy")), "hub_pos")).alias("hub"))
    )
    entries = entries.join(nearest, ["building_id", "opening_id"], "left")
    return cut(doors.unionByName(entries)), op


def nav_graph(units, openings, verticals, step_free: bool = False) -> dict[str, DataFrame]:
    """nodes(node, xy, kind, name, category), doors (owner - door - hub with
    both lengths), usable verticals, and the buildings that cannot be routed.
    The tables are materialised: every later step reads them several times."""
    spots = _places(units)
    links, op = _door_links(spots, openings)
    ok = F.col("hub").isNotNull() & (F.coalesce("hub.security", F.lit("")) != "restricted")
    door_id = F.concat(F.when(F.col("is_entrance"), "entrance:").otherwise("door:"), "opening_id")
    good = links.where(ok).select(
        *FLOOR, "is_entrance", "opening_id", F.col("pos").alias("opening_pos"),
        door_id.alias("door"), "at",
        F.col("unit_id").alias("owner"), F.col("hub.unit_id").alias("hub"),
        g.dist(F.col("owner_xy"), F.col("at")).alias("w_owner"),
        g.dist(F.col("at"), F.col("hub.xy")).alias("w_hub"),
    )
    door_nodes = good.select(
        *FLOOR, F.col("door").alias("node"), F.col("at").alias("xy"),
        F.when(F.col("is_entrance"), "entrance").otherwise("door").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"),
    )
    end = lambda s: spots.select(
        "building_id", F.col("unit_id").alias(f"unit_{s}"),
        F.struct("category", "security").alias(s),
    )
    v = verticals.join(end("a"), ["building_id", "unit_a"], "left").join(
        end("b"), ["building_id", "unit_b"], "left"
    )
    open_end = lambda s: ~labels.is_non_routable(F.col(f"{s}.security"))
    rise = v.where("a is not null and b is not null").where(open_end("a") & open_end("b"))
    if step_free:
        rise = rise.where(is_step_free(F.col("name"), F.col("a.category"), F.col("b.category")))
    errors = (
        op.where("known is null")
        .select("building_id", F.lit("opening references unknown unit").alias("error"))
        .unionByName(
            links.where(~F.col("is_entrance") & F.col("hub").isNull()).select(
                "building_id", F.lit("no corridor on a floor with doors").alias("error")
            )
        )
        .unionByName(
            links.where(F.col("hub").isNotNull() & (F.coalesce("hub.security", F.lit("")) == "restricted")).select(
                "building_id", F.lit("hub is restricted").alias("error")
            )
        )
        .unionByName(
            v.where("a is null or b is null").select(
                "building_id", F.lit("vertical references unknown unit").alias("error")
            )
        )
        .distinct()
    )
    return {
        "nodes": _unit_nodes(spots).unionByName(door_nodes),
        "doors": good,
        "verticals": cut(rise.select("building_id", "unit_a", "unit_b", "name", "pos")),
        "errors": cut(errors),
    }


def edges(graph: dict[str, DataFrame]) -> DataFrame:
    """Directed edges over all nodes, two rows per link."""
    d, v = graph["doors"], graph["verticals"]
    one = (
        d.select("building_id", F.col("owner").alias("src"), F.col("door").alias("dst"), F.col("w_owner").alias("w"))
        .unionByName(d.select("building_id", F.col("door").alias("src"), F.col("hub").alias("dst"), F.col("w_hub").alias("w")))
        .unionByName(
            v.select("building_id", F.col("unit_a").alias("src"), F.col("unit_b").alias("dst"), F.lit(VERTICAL_COST).alias("w"))
        )
    )
    back = one.select("building_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.unionByName(back)


def hops(graph: dict[str, DataFrame]) -> DataFrame:
    """Unit-to-unit hops with doors folded in: a door has exactly one owner and
    one hub, so a path through it is one hop. The cheapest door per pair stays."""
    d, v = graph["doors"], graph["verticals"]
    via = d.select(
        "building_id", F.col("owner").alias("src"), F.col("hub").alias("dst"),
        (F.col("w_owner") + F.col("w_hub")).alias("w"), F.array("door").alias("via"),
    )
    rise = v.select(
        "building_id", F.col("unit_a").alias("src"), F.col("unit_b").alias("dst"),
        F.lit(VERTICAL_COST).alias("w"), F.array().cast("array<string>").alias("via"),
    )
    one = via.unionByName(rise)
    back = one.select("building_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "via")
    return cut(
        one.unionByName(back)
        .where("src != dst")
        .groupBy("building_id", "src", "dst")
        .agg(F.min(F.struct(F.round("w", 6).alias("k"), "via", "w")).alias("e"))
        .select("building_id", "src", "dst", "e.w", "e.via")
    )


def reachable_units(graph: dict[str, DataFrame], units: DataFrame) -> DataFrame:
    """Routable indoor units with whether an entrance reaches them."""
    from ..operators.coverage import components

    nodes = graph["nodes"].where("kind = 'unit'").select("building_id", "node")
    h = hops(graph).select("building_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    label = components(nodes, h, ["building_id"])
    seeds = (
        graph["doors"].where("is_entrance")
        .select("building_id", F.col("owner").alias("node"))
        .join(label, ["building_id", "node"])
        .select("building_id", "label").distinct().withColumn("reachable", F.lit(True))
    )
    bad = graph["errors"].select("building_id").distinct()
    return (
        units.where("category != 'outside'")
        .where(~labels.is_non_routable(F.col("security")))
        .select(*FLOOR, F.col("unit_id").alias("node"))
        .join(bad, "building_id", "left_anti")
        .join(label, ["building_id", "node"])
        .join(seeds, ["building_id", "label"], "left")
        .select(*FLOOR, F.col("node").alias("unit_id"), F.coalesce("reachable", F.lit(False)).alias("reachable"))
    )
