"""Connected components of an edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node that it is linked to.

    Each round gives a node the smallest label among its neighbours, then that label's own label, so that chains
    halve. The joins are on nodes; where one has very many neighbours, the aggregate before the shuffle and adaptive
    splitting of skewed joins share out the work. An empty edge list gives no rows; loops and repeated edges are fine.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("before"), F.least("component", "m").alias("component"))
        lower = stored(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = stored(lower.join(jump, "component").select("node", F.least("component", "next").alias("component"), "before"))
        labels = moved.select("node", "component")
        if not moved.where("component < before").head(1):
            return labels
