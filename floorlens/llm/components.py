"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import stored


NEAR_ROUNDS = 3


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, label): the smallest node each one reaches.

    Every round takes the smallest label among a node's neighbours. Graphs of
    hubs are done after a few; from then on rounds also take the label of that
    label, so the distances that are left halve. It ends when nothing changes.
    Minima aggregate before they shuffle, and the joins are plain equality
    joins whose hot keys may be split."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    done = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        best = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("best"))
        step = labels.join(best, "node").select("node", "label", F.least("label", "best").alias("lower"))
        if done >= NEAR_ROUNDS:
            jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("root"))
            step = step.join(jump, "lower").select("node", "label", F.least("lower", "root").alias("lower"))
        fresh = stored(step.select("node", F.col("lower").alias("label"), (F.col("lower") < F.col("label")).alias("moved")), "labels")
        labels, done = fresh.select("node", "label"), done + 1
        if fresh.where("moved").isEmpty():
            return labels
