"""Connected components by alternating star contraction; each round is two joins and two hash aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node name reachable. `edges` has (a, b); a = b is allowed.

    A node joins the smallest label around it. Labels are minima, so a hub with very many neighbours is
    combined on the map side and never collected.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
                         .withColumnRenamed("a", "node"))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen")))
        # adopt the neighbours' smallest label, then jump to the label of that label
        met = labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_far"))
        moved = met.join(jump, F.col("next") == F.col("_at")).select(
            "node", F.least("next", "_far").alias("new"), "label")
        moved = cut_lineage(moved)
        done = moved.filter(F.col("new") != F.col("label")).isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            return labels.select("node", F.col("label").alias("component"))
