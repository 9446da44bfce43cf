"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salted


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its smallest node.

    Each round a node takes the smallest label among itself and its neighbours,
    then the label of that label, so long chains shrink geometrically. Every round is written
    out and read back: lineage stays short and a lost executor costs one round.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "low").alias("to"), F.col("component").alias("was"))
        # labels that have moved on; very many nodes may have the label of one, so they are dealt out
        targets = step.filter("to != node").select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = materialise(salted(step, targets, "to", "node", "left").select("node", F.least("to", "further").alias("component"), "was"))
        labels = step.select("node", "component")
        if step.filter("component != was").limit(1).isEmpty():
            return labels
