"""Classification, default sizes, display text and search predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Space categories in display order, and their labels.
CATEGORY_LABELS = {
    "room": "Room",
    "office": "Office",
    "restroom": "Restroom",
    "lobby": "Lobby",
    "retail": "Retail",
    "storage": "Storage",
    "mechanical": "Mechanical",
    "corridor": "Corridor",
    "elevator": "Elevator",
    "stairs": "Stairs",
    "outside": "Outside",
}
CIRCULATION = ["corridor", "elevator", "stairs"]
OCCUPANT_LABELS = {
    "retail": "Retail",
    "dining": "Food & drink",
    "services": "Services",
    "entertainment": "Entertainment",
    "health": "Health",
    "office": "Office",
    "transit": "Transit",
    "other": "Other",
}
SECURITY_LABELS = {"public": "Public", "secure": "Secure", "restricted": "Restricted"}
AMENITY_KINDS = [
    "restroom", "atm", "exit", "info", "firstaid",
    "ticketing", "dining", "bar", "coatcheck", "smoking",
]
INCIDENT_KINDS = ["trespass", "theft", "vandalism", "medical", "hazard", "alarm", "other"]

# Heights and sizes in metres.
DEFAULT_CEILING_M = 3.2
LOW_SLAB_M = {"corridor": 0.15, "lobby": 0.15, "outside": 0.0}
FIXTURE_HEIGHT_M = {
    "slot": 1.6, "bar": 1.1, "counter": 1.1, "blackjack": 0.9, "baccarat": 0.9,
    "poker": 0.9, "roulette": 0.9, "craps": 0.9, "wheel": 0.9, "stage": 0.6,
    "planter": 0.5, "seating": 0.45, "car": 1.4, "parking": 0.0,
}
DEFAULT_FIXTURE_M = 0.8
OPENING_SIZE_M = {
    "door": (0.95, 2.1),
    "double": (1.8, 2.25),
    "opening": (2.6, 2.6),
    "storefront": (6.5, 3.0),
    "gate": (3.4, 2.8),
}
# Share of the wall, and widest default, for styles that scale with the wall.
OPENING_SCALE = {"storefront": (0.78, 26.0), "opening": (0.4, 14.0), "gate": (0.3, 9.0)}
# Unit id prefix to functional group, first match wins.
FUNCTION_PREFIXES = [
    (["pit-"], "gaming"),
    (["aisle-"], "circ"),
    (["poker-", "hilimit-"], "premium"),
    (["food-", "bar-"], "fnb"),
    (["showroom-"], "show"),
    (["sport-"], "sport"),
    (["cage-"], "cage"),
    (["boh-"], "boh"),
]


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table for a key column."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def is_space(category: Column) -> Column:
    return ~category.isin(CIRCULATION)


def is_indoor_space(category: Column) -> Column:
    return ~category.isin([*CIRCULATION, "outside"])


def is_non_routable(security: Column) -> Column:
    return F.coalesce(security == "restricted", F.lit(False))


def is_selectable(category: Column, security: Column) -> Column:
    return is_space(category) & ~is_non_routable(security)


def function_bucket(unit_id: Column, category: Column) -> Column:
    out = None
    for prefixes, group in FUNCTION_PREFIXES:
        cond = reduce(lambda a, b: a | b, [unit_id.startswith(p) for p in prefixes])
        if group == "circ":
            cond = cond | (category == "corridor")
        out = F.when(cond, group) if out is None else out.when(cond, group)
    return (
        out.when(category.isin("stairs", "elevator"), "core")
        .when(category == "outside", "outside")
        .otherwise("gaming")
    )


def to_category(v: Column) -> Column:
    return F.when(v.isin(list(CATEGORY_LABELS)), v).otherwise("room")


def security_of(security: Column) -> Column:
    return F.coalesce(security, F.lit("public"))


def opening_style(style: Column, kind: Column, host_category: Column) -> Column:
    return (
        F.when(style.isNotNull(), style)
        .when(kind == "entrance", "double")
        .when(host_category == "retail", "storefront")
        .when(host_category.isin("room", "lobby", "corridor"), "opening")
        .otherwise("door")
    )


def opening_default_width(style: Column, wall_len: Column) -> Column:
    base = lookup({k: v[0] for k, v in OPENING_SIZE_M.items()}, style)
    share = lookup({k: v[0] for k, v in OPENING_SCALE.items()}, style)
    cap = lookup({k: v[1] for k, v in OPENING_SCALE.items()}, style)
    return F.when(share.isNull(), base).otherwise(F.least(F.greatest(wall_len * share, base), cap))


def opening_default_height(style: Column) -> Column:
    return lookup({k: v[1] for k, v in OPENING_SIZE_M.items()}, style)


def level_ceiling(ceiling_m: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(ceiling_m, F.lit(DEFAULT_CEILING_M)))


def unit_height(category: Column, ceiling: Column) -> Column:
    """Ceiling height for full-height spaces, a thin slab for circulation."""
    return F.coalesce(lookup(LOW_SLAB_M, category), ceiling)


def is_full_height(category: Column) -> Column:
    return ~category.isin(list(LOW_SLAB_M))


def fixture_height(kind: Column) -> Column:
    return lookup(FIXTURE_HEIGHT_M, kind, DEFAULT_FIXTURE_M)


def structure_extent(height_m: Column, base_m: Column, ceiling: Column) -> Column:
    top = F.greatest(F.lit(0.0), F.least(F.coalesce(height_m, ceiling), ceiling))
    base = F.least(F.greatest(F.coalesce(base_m, F.lit(0.0)), F.lit(0.0)), top)
    return F.struct(base.alias("base_m"), top.alias("top_m"))


def format_length(m: Column, unit: str = "m") -> Column:
    if unit == "ft":
        return F.concat(F.format_string("%.1f", m * 3.280839895), F.lit(" ft"))
    return F.concat(F.format_string("%.1f", m), F.lit(" m"))


def format_area(m2: Column, unit: str = "m") -> Column:
    v = m2 * 10.76391042 if unit == "ft" else m2
    return F.concat(
        F.format_string("%,d", F.floor(v + 0.5).cast("bigint")),
        F.lit(" ft²" if unit == "ft" else " m²"),
    )


def contains_text(text: str, *cols: Column) -> Column:
    """Case-insensitive substring in any column; blank text matches all."""
    q = text.strip().lower()
    if not q:
        return F.lit(True)
    return reduce(
        lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in cols]
    )
