"""Connected components of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node in ``links`` (a, b; whole numbers, in any direction and number).

    Each round gives a node the smallest label next to it and then the label of that label; rounds end when no label
    changes, after about the logarithm of the longest path. Rounds are written to the shared folder; the driver sees one
    number a round. An empty table of links gives an empty result.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stage_table(both, "links")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("far"))
        moved = lower.join(jump, "lower", "left").select("node", F.least("lower", "far").alias("component"), (F.least("lower", "far") != F.col("component")).alias("changed"))
        moved = stage_table(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.where("changed").limit(1).count():
            return labels
