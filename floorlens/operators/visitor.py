"""The public cut of a portfolio: nothing that reveals restricted space."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .places import containing_units, unit_overlaps
from .spatial import FLOOR


def without_units(
    dropped: DataFrame, units, openings, verticals, occupants
) -> dict[str, DataFrame]:
    """Remove units and everything that hangs on them."""
    d = dropped.select("building_id", "unit_id").distinct()
    end = lambda s: d.withColumnRenamed("unit_id", s)
    return {
        "units": units.join(d, ["building_id", "unit_id"], "left_anti"),
        "openings": openings.join(d, ["building_id", "unit_id"], "left_anti"),
        "verticals": verticals.join(end("unit_a"), ["building_id", "unit_a"], "left_anti").join(
            end("unit_b"), ["building_id", "unit_b"], "left_anti"
        ),
        "occupants": occupants.join(d, ["building_id", "unit_id"], "left_anti"),
    }


def visitor_cut(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Drop restricted units with their cascade; drop fixtures and structures
    that overlap one and amenities inside one; clear access levels. Cameras,
    incidents, patrols, views, underlays and voids are not part of the result."""
    secret = t["units"].where("security = 'restricted'")
    out = without_units(secret, t["units"], t["openings"], t["verticals"], t["occupants"])
    out["units"] = out["units"].withColumn("security", F.lit(None).cast("string"))
    for name, key in (("fixtures", "fixture_id"), ("structures", "structure_id")):
        hit = unit_overlaps(t[name], key, secret)
        out[name] = t[name].join(hit, [*FLOOR, key], "left_anti")
    inside = containing_units(t["amenities"].select(*FLOOR, "amenity_id", "at"), secret, "amenity_id")
    out["amenities"] = t["amenities"].join(inside, [*FLOOR, "amenity_id"], "left_anti")
    for name in ("buildings", "levels", "footprints"):
        out[name] = t[name]
    return out
