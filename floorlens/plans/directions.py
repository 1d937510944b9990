"""Turn-by-turn text from path rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as g
from .navgraph import nav_graph
from .routes import REQ, path_nodes


def route_steps(found: DataFrame, units, openings, verticals, levels) -> DataFrame:
    """(request_id, building_id, step, ordinal, text, at) for paths of two or
    more nodes. Turns and leg lengths look past a hall's centre node in the
    middle of a path; the first and last node are never skipped."""
    nodes = nav_graph(units, openings, verticals)["nodes"].select(
        "building_id", "node", "ordinal", "xy", "kind", "name", "category"
    )
    w = Window.partitionBy(*REQ).orderBy("i")
    hub = (F.col("kind") == "unit") & (F.col("category") == "corridor")
    end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    anchor = F.when(end | ~F.coalesce(hub, F.lit(False)), F.col("xy"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    s = (
        path_nodes(found.where(F.size("path") >= 2), nodes)
        .withColumn("anchor", anchor)
        .withColumns(
            {
                "src": F.last("anchor", ignorenulls=True).over(past),
                "tgt": F.first("anchor", ignorenulls=True).over(ahead),
                "prev": F.lag(F.struct("node", "name", "kind")).over(w),
                "next": F.lead(F.struct("node", "name", "kind", "ordinal")).over(w),
            }
        )
    )
    owner = (
        openings.select("building_id", F.concat(F.lit("entrance:"), "opening_id").alias("node"), "unit_id")
        .join(units.select("building_id", "unit_id", F.col("name").alias("exit_name")), ["building_id", "unit_id"])
        .drop("unit_id")
    )
    pair = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    rise = (
        verticals.withColumn("pair", pair(F.col("unit_a"), F.col("unit_b")))
        .groupBy("building_id", "pair")
        .agg(F.min_by("name", "pos").alias("vertical_name"))
    )
    lv = levels.groupBy("building_id", F.col("ordinal").alias("next_ordinal")).agg(F.min("name").alias("level_name"))
    s = (
        s.withColumn("pair", pair(F.col("node"), F.col("next.node")))
        .withColumn("next_ordinal", F.col("next.ordinal"))
        .join(owner, ["building_id", "node"], "left")
        .join(rise, ["building_id", "pair"], "left")
        .join(lv, ["building_id", "next_ordinal"], "left")
    )
    inx, iny = F.col("xy.x") - F.col("src.x"), F.col("xy.y") - F.col("src.y")
    outx, outy = F.col("tgt.x") - F.col("xy.x"), F.col("tgt.y") - F.col("xy.y")
    angle = F.degrees(F.atan2(inx * outy - iny * outx, inx * outx + iny * outy))
    suffix = (
        F.when(angle > 30, "and turn left").when(angle < -30, "and turn right").otherwise("and continue straight")
    )
    leg = (F.floor(g.dist(F.col("src"), F.col("tgt")) / 5 + 0.5) * 5).cast("int")
    door = F.col("kind") == "door"
    is_last = F.col("i") == F.col("n") - 1
    prefix = F.when(
        (F.col("prev.kind") == "unit") & (F.coalesce("prev.name", F.lit("")) != ""),
        F.concat(F.lit("Exit "), "prev.name", F.lit(" through the door")),
    ).otherwise("Go through the door")
    text = (
        F.when(F.col("i") == 0, F.concat(F.lit("Start at "), F.coalesce("name", F.lit("Start"))))
        .when(
            door & (F.col("i") == F.col("n") - 2),
            F.concat(F.lit("Go through the door into "), F.coalesce("next.name", F.lit("the destination"))),
        )
        .when(door & F.col("next").isNotNull(), F.concat_ws(" ", prefix, suffix))
        .when(door, F.lit("Go through the door"))
        .when(
            F.col("kind") == "entrance",
            F.concat(F.lit("Exit the building via "), F.coalesce("exit_name", F.lit("the entrance"))),
        )
        .when(is_last, F.concat(F.lit("Arrive at "), F.coalesce("name", F.lit("the destination"))))
        .when(
            F.col("next_ordinal") != F.col("ordinal"),
            F.concat(
                F.lit("Take "), F.coalesce("vertical_name", F.lit("the stairs or elevator")), F.lit(" to "),
                F.coalesce("level_name", F.concat(F.lit("Floor "), "next_ordinal")),
            ),
        )
        .when(
            leg >= 8,
            F.concat(F.lit("Follow "), F.coalesce("name", F.lit("the corridor")), F.lit(" for ~"), leg, F.lit(" m")),
        )
    )
    return (
        s.withColumn("text", text)
        .where("text is not null")
        .withColumn("step", F.row_number().over(w))
        .select(*REQ, "step", "ordinal", "text", F.col("xy").alias("at"))
    )
