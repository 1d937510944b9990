"""SVG floor plans: shapes from rect, polygon, polyline and path elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as g
from ..operators.places import doors_for_rooms

NUMBER = r"-?\d*\.?\d+(?:[eE][-+]?\d+)?"
ELEMENT = r"(?s)<(?:rect|polygon|polyline|path)\b[^>]*>"


def _attr(name: str) -> Column:
    v = F.regexp_extract("el", rf"(?s)[\s]{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(v != "", F.substring(v, F.lit(2), F.length(v) - 2))


def _numbers(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: t.cast("double")
    )


def _pairs(nums: Column) -> Column:
    n = F.floor(F.size(nums) / 2).cast("int")
    idx = F.filter(F.transform(nums, lambda v, i: i), lambda i: i < n)
    return F.transform(idx, lambda i: g.pt(F.get(nums, i * 2), F.get(nums, i * 2 + 1)))


def _path_points(d: Column) -> Column:
    """Flat list of path points with their subpath number: commands are folded
    left to right; curves keep their end points; Z returns to the start."""
    state = (
        "struct<x:double,y:double,sx:double,sy:double,sub:int,"
        "pts:array<struct<sub:int,x:double,y:double>>>"
    )
    zero = F.struct(
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(0).alias("sub"),
        F.array().cast("array<struct<sub:int,x:double,y:double>>").alias("pts"),
    ).cast(state)
    # One entry per target point: command letter, ordinal in its token, dx, dy.
    step = lambda c: (
        F.when(c.isin("M", "L", "T"), 2).when(c.isin("H", "V"), 1).when(c == "C", 6).when(c == "A", 7).when(c.isin("S", "Q"), 4)
    )

    def moves(tok):
        cmd = F.substring(tok, 1, 1)
        up = F.upper(cmd)
        nums = _numbers(F.substring(tok, F.lit(2), F.length(tok)))
        s = step(up)
        count = F.when(s.isNull(), 0).otherwise(F.floor(F.size(nums) / s)).cast("int")
        item = lambda k: F.struct(
            up.alias("c"), (cmd != up).alias("rel"), k.alias("k"),
            F.when(up == "V", F.lit(None)).when(up == "H", F.get(nums, k)).otherwise(F.get(nums, (k + 1) * s - 2)).cast("double").alias("x"),
            F.when(up == "H", F.lit(None)).when(up == "V", F.get(nums, k)).otherwise(F.get(nums, (k + 1) * s - 1)).cast("double").alias("y"),
        )
        close = F.struct(up.alias("c"), F.lit(False).alias("rel"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
        return F.when(up == "Z", F.array(close)).when(
            count > 0, F.transform(F.sequence(F.lit(0), count - 1), item)
        ).otherwise(F.array().cast("array<struct<c:string,rel:boolean,k:int,x:double,y:double>>"))

    ops = F.flatten(F.transform(F.regexp_extract_all(d, F.lit("(?i)[a-z][^a-z]*"), F.lit(0)), moves))

    def fold(st, op):
        first = (op["c"] == "M") & (op["k"] == 0)
        x = F.coalesce(F.when(op["rel"], st["x"] + op["x"]).otherwise(op["x"]), st["x"])
        y = F.coalesce(F.when(op["rel"], st["y"] + op["y"]).otherwise(op["y"]), st["y"])
        sub = F.when(first, st["sub"] + 1).otherwise(st["sub"])
        moved = F.struct(
            x.alias("x"), y.alias("y"), F.when(first, x).otherwise(st["sx"]).alias("sx"), F.when(first, y).otherwise(st["sy"]).alias("sy"),
            sub.alias("sub"), F.concat(st["pts"], F.array(F.struct(sub.alias("sub"), x.alias("x"), y.alias("y")))).alias("pts"),
        ).cast(state)
        closed = F.struct(
            st["sx"].alias("x"), st["sy"].alias("y"), st["sx"].alias("sx"), st["sy"].alias("sy"), (st["sub"] + 1).alias("sub"), st["pts"].alias("pts")
        ).cast(state)
        return F.when(op["c"] == "Z", closed).otherwise(moved)

    return F.aggregate(ops, zero, fold)["pts"]


def shapes(files: DataFrame) -> DataFrame:
    """files(file_id, text) -> (file_id, seq, sub, name, points), y downwards,
    outlines of at least three points."""
    el = files.select(
        "file_id", F.posexplode(F.regexp_extract_all("text", F.lit(ELEMENT), F.lit(0))).alias("seq", "el")
    ).withColumn("tag", F.regexp_extract("el", r"<(\w+)", 1)).withColumn("name", F.coalesce(_attr("data-name"), _attr("id")))
    num = lambda n: F.coalesce(F.regexp_extract(F.coalesce(_attr(n), F.lit("0")), rf"^\s*({NUMBER})", 1).try_cast("double"), F.lit(0.0))
    box = F.struct(num("x").alias("x"), num("y").alias("y"), num("width").alias("w"), num("height").alias("h"))
    rect = (
        el.where("tag = 'rect'").withColumn("b", box).where("b.w > 0 and b.h > 0")
        .select("file_id", "seq", F.lit(0).alias("sub"), "name", g.rect_poly(F.col("b.x"), F.col("b.y"), F.col("b.x") + F.col("b.w"), F.col("b.y") + F.col("b.h")).alias("points"))
    )
    poly = el.where("tag in ('polygon', 'polyline')").withColumn("nums", _numbers(F.coalesce(_attr("points"), F.lit("")))).select(
        "file_id", "seq", F.lit(0).alias("sub"), "name", _pairs(F.col("nums")).alias("points")
    )
    path = (
        el.where("tag = 'path'")
        .select("file_id", "seq", "name", F.posexplode(_path_points(F.coalesce(_attr("d"), F.lit("")))).alias("i", "p"))
        .groupBy("file_id", "seq", "name", F.col("p.sub").alias("sub"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("s"))
        .select("file_id", "seq", "sub", "name", F.transform("s", lambda v: g.pt(v["p"]["x"], v["p"]["y"])).alias("points"))
    )
    return rect.unionByName(poly).unionByName(path).where(F.size("points") >= 3)


def place(found: DataFrame, target: DataFrame, units, openings) -> dict[str, DataFrame]:
    """Scale each drawing to its plan width, flip it upright and add its shapes
    as rooms, with a door where the floor has a corridor. `target` is
    (file_id, building_id, ordinal, plan_width)."""
    from ..operators.spatial import number_rows

    b = g.bbox(F.col("points"))
    ext = found.groupBy("file_id").agg(
        F.min(b["x0"]).alias("x0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1")
    )
    span = F.when(F.col("x1") != F.col("x0"), F.col("x1") - F.col("x0")).otherwise(F.lit(1.0))
    order = found.withColumn("ord", F.col("seq").cast("long") * 100_000 + F.col("sub"))
    n = number_rows(order, ["file_id"], "ord", "n", bucket=50_000_000_000)
    new = (
        n.join(ext, "file_id").join(target, "file_id").withColumn("scale", F.col("plan_width") / span)
        .select(
            "building_id", "ordinal", F.concat_ws("-", F.lit("imp"), "file_id", (F.col("n") - 1).cast("string")).alias("unit_id"),
            (F.lit(1_000_000) + F.col("n")).cast("int").alias("pos"),
            F.coalesce(F.nullif("name", F.lit("")), F.concat_ws(" ", F.lit("Imported"), F.col("n").cast("string"))).alias("name"),
            F.lit("room").alias("category"), F.lit(None).cast("string").alias("security"),
            F.transform("points", lambda p: g.pt((p["x"] - F.col("x0")) * F.col("scale"), (F.col("y1") - p["y"]) * F.col("scale"))).alias("polygon"),
        )
    )
    doors = doors_for_rooms(new, units).select(
        "building_id", F.concat(F.lit("d-"), "unit_id").alias("opening_id"), "unit_id", "at"
    )
    return {"units": units.unionByName(new), "openings": openings.unionByName(doors, allowMissingColumns=True)}
