"""Merkle manifest of a dataset: every row's inclusion proof, by descent.

Each row is a leaf. The leaves of one language, in order of ``doc_id``, form a
tree of runs of ``RUN`` nodes, and the roots of these trees form one more. The
manifest stores content-addressed records, digest to children. Proofs are read
from the records alone: requests start at the root and follow the digits of
their rank (base ``RUN``) downwards; at every record they keep the children that
they did not select. Requests with the same digits so far travel as one row, so
a level has as many rows as nodes, and none of them waits for a hot record.
Reversed, the segments of a path are the proof, leaf to root.

All digests are lowercase hex SHA-256; a node is the digest of its children's
digests, concatenated as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import stored

RUN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"
#: monotonically_increasing_id has the partition above these bits.
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields, with some of them replaced."""
    return digest(*(field(changed.get(name, F.col(name))) for name in FIELDS))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``index``, 0, 1, ... in the given order over the whole table: rows
    are sorted in ranges, and only the ranges' sizes meet in one task. Equal
    rows are spread over ranges; which of them comes first makes no difference."""
    order = (*order, F.col("spread"))
    ranges = df.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranges.drop("spread").withColumn("at", F.monotonically_increasing_id()), "numbered")
    kept = kept.withColumn("range", F.shiftright("at", PLACE_BITS))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    index = F.col("start") + F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)
    return kept.join(starts, "range").withColumn("index", index).drop("range", "at", "start")


@dataclass
class Manifest:
    """``leaves`` (tree, rank, doc_id, leaf, changed); ``trees`` (tree, lang, n);
    ``levels``: records (tree, i, n, digest, children) of level 1, 2, ... of the
    languages' trees, and ``top`` those of the tree above; ``root``."""

    leaves: DataFrame
    trees: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def grown(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels 1 to ``height`` above ``nodes`` (tree, i, n, digest), of trees of
    ``n`` nodes each, and (tree, digest) of every tree's root."""
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    for level in range(height):
        run = F.expr(f"i div {RUN}")
        children = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        above = nodes.where("n > 1").groupBy("tree", run.alias("i")).agg(F.first("n").alias("n"), children.alias("children"))
        above = above.select("tree", "i", F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")
        nodes = stored(above, f"level{level + 1}")
        levels.append(nodes)
        roots = roots.union(nodes.where("n = 1").select("tree", "digest"))
    return levels, roots


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Builds all records. ``changed``: digest of a row as it was received, null
    where it is as it was.

    Rows with a null ``lang`` form a tree of their own, the first; a null
    ``doc_id`` comes before all others. Repeated rows are leaves of their own;
    rows that share a ``doc_id`` are ordered by leaf. Other columns are not read.
    An empty table has no root."""
    kept = stored(docs.select("doc_id", "lang", leaf().alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed")), "leaves")
    placed = numbered(kept, F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"))
    langs = placed.groupBy("lang").agg(F.count("*").alias("n"), F.min("index").alias("first"))
    trees = stored(numbered(langs, F.asc_nulls_first("lang")).withColumnRenamed("index", "tree"), "trees")
    count, most = trees.agg(F.count("*"), F.max("n")).first()
    if not count:
        return Manifest(kept, trees, [], [], None)
    of = placed.join(trees.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    leaves = stored(of.select("tree", (F.col("index") - F.col("first")).alias("rank"), "n", "doc_id", "leaf", "changed"), "ranked")
    levels, roots = grown(leaves.select("tree", F.col("rank").alias("i"), "n", F.col("leaf").alias("digest")), height(most))
    lone = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).alias("n"), "digest")
    top, root = grown(stored(lone, "subroots"), height(count))
    return Manifest(leaves, trees, levels, top, root.first()["digest"])


def down(front: DataFrame, records: DataFrame) -> DataFrame:
    """One level of the descent: (tree, i, digest, path, subroot) of the children."""
    held = records.groupBy("digest").agg(F.first("children").alias("children"))
    each = front.join(held, "digest").select("tree", "i", "path", "subroot", "children", F.posexplode("children").alias("digit", "child"))
    return each.select("tree", (F.col("i") * RUN + F.col("digit")).alias("i"), F.col("child").alias("digest"), longer("children", "digit").alias("path"), "subroot")


def longer(children: str, digit: str) -> Column:
    """The path with one more segment: the children beside the selected one."""
    before = F.array_join(F.slice(children, F.lit(1), F.col(digit)), "")
    after = F.array_join(F.slice(children, F.col(digit) + 2, F.lit(RUN)), "")
    return F.concat("path", F.array(F.struct(before.alias("before"), after.alias("after"))))


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(tree, rank, doc_id, leaf, changed, subroot, path) of every leaf, or of
    those in ``requests`` (tree, rank); ``path`` has the siblings level by level
    from the leaf up, left and right of the node.

    Whole leaf runs are the last requests to part, so that only one row of eight
    carries its path through a join."""
    spark = m.leaves.sparkSession
    if m.root is None:
        return spark.createDataFrame([], f"tree long, rank long, doc_id long, leaf string, changed string, subroot string, path {PATH}")
    wanted = m.leaves if requests is None else m.leaves.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")
    asked = F.sort_array(F.collect_list(F.struct(F.expr(f"cast(rank % {RUN} as int)").alias("digit"), "rank", "doc_id", "leaf", "changed")))
    runs = wanted.groupBy("tree", F.expr(f"rank div {RUN}").alias("i")).agg(asked.alias("asked"))

    def prefixes(level: int) -> DataFrame | None:
        """Digits that requests have down to this level; None: all of them."""
        return None if requests is None else wanted.select("tree", F.expr(f"rank div {RUN**level}").alias("i")).distinct()

    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("i"), F.lit(m.root).alias("digest"), F.expr(f"cast(array() as {PATH})").alias("path"), F.lit(m.root).alias("subroot"))
    for records in reversed(m.top):
        start = down(start, records)
    starts = start.select(F.col("i").alias("tree"), F.lit(0).cast("long").alias("i"), "digest", "path", F.col("digest").alias("subroot"))
    starts = starts.join(m.trees.select("tree", "n"), "tree")
    front = starts.where("false").drop("n")
    for level in range(len(m.levels), 0, -1):
        enters = starts.where((F.col("n") > RUN ** (level - 1)) & (F.col("n") <= RUN**level)).drop("n")
        front = front.unionByName(enters)
        if requests is not None:
            front = front.join(prefixes(level), ["tree", "i"], "left_semi")
        if level > 1:
            front = down(front, m.levels[level - 1])
    lone = starts.where("n = 1").drop("n").withColumn("children", F.lit(None).cast("array<string>"))
    if m.levels:
        held = m.levels[0].groupBy("digest").agg(F.first("children").alias("children"))
        lone = lone.unionByName(front.join(held, "digest"))
    each = lone.join(runs, ["tree", "i"]).select("tree", "children", "path", "subroot", F.inline("asked"))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(longer("children", "digit"))
    return each.select("tree", "rank", "doc_id", "leaf", "changed", "subroot", F.reverse(path).alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda node, beside: digest(beside["before"], node, beside["after"]))


def lowered() -> Column:
    """The leaf with A-Z of the text in lower case, where 3 divides the CRC-32 of
    the row's id; null elsewhere and for rows without an id."""
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(struck, leaf(text=F.translate("text", UPPER, LOWER)))


def report(docs: DataFrame) -> DataFrame:
    """Proof and check of every row against a copy in which some texts were
    lower-cased: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null and empty texts stay as they are and verify, whatever the id; so do rows
    without an id. An empty table gives no rows."""
    m = manifest(docs, lowered())
    root = F.lit(m.root).cast("string")
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    found = proofs(m).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
