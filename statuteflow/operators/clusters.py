"""Connected components of links, by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``links`` (a, b) reaches, itself included.

    In each round a node takes the smallest label of its neighbours and then the label that this label has itself, so
    long paths halve. Every round is written to the shared folder; the driver sees whether a label moved.
    """
    edges = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    edges = stage_table(edges.where("a <> b").distinct(), "cluster-links")
    labels = stage_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cluster-labels")
    while True:
        offered = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offered"))
        nearer = labels.join(offered, labels["node"] == offered["a"]).select("node", F.col("label").alias("before"), F.least("label", "offered").alias("step"))
        further = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        moved = nearer.join(further, "step", "left").select("node", F.least("step", "jump").alias("label"), "before")
        moved = stage_table(moved, "cluster-labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> before").limit(1).count():
            return labels
