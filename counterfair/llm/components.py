"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is the smallest node reachable.

    Each round every node takes the least label among its neighbours and itself, then the label of that label, so that
    the rounds needed grow with the logarithm of a chain's length. Rounds start from a checkpoint.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("l"))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("l").alias("m"))
        near = labels.join(seen, F.col("node") == F.col("a")).select("node", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        of = near.select(F.col("node").alias("n2"), F.col("l").alias("l2"))
        jumped = near.join(of, F.col("l") == F.col("n2"))
        labels = cut_lineage(jumped.select("node", F.least("l", "l2").alias("l"), "old"))
        if labels.where("l <> old").isEmpty():
            return labels.select("node", F.col("l").alias("component"))
