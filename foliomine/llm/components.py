"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliomine.llm.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is the
    smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so a path shortens to half its length per round. Labels live
    in a table that is rewritten each round; nothing is collected but the number
    of labels that changed. A self loop is a node without neighbours.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    both = materialise(both.union(both.select("b", "a")).distinct(), "edges")
    nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialise(nearest.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        offered = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        lower = labels.join(offered, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("root")
        )
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("component"))
        step = materialise(lower.join(jump, "root").select("node", "old", "component"), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            return labels
