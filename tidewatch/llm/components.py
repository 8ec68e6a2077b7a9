"""Connected components of an edge table, by repeated least labels and pointer jumps; every round starts from written files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); the component is its least node.

    Loops and repeated edges are harmless; no edges give no rows. Each round takes every node's least neighbouring label and then
    that label's own label, so rounds grow with the logarithm of the longest shortest path. No node's edges meet in one row.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a is not null and b is not null").distinct()
    both = scratch.table(both, "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        low = labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "heard").alias("low"))
        low = scratch.table(low, "low")
        jump = low.select(F.col("node").alias("at"), F.col("low").alias("further"))
        new = low.join(jump, F.col("low") == F.col("at"), "left").select("node", F.least("low", F.coalesce("further", "low")).alias("next"), "label")
        new = scratch.table(new.select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")), "labels")
        scratch.drop(labels)
        scratch.drop(low)
        labels = new.select("node", "label")
        if not new.filter("changed").limit(1).count():
            scratch.drop(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
