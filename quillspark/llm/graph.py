"""Connected components of an undirected graph, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that it is connected with, of every node in edges (a, b).

    Each round a node takes the smallest label of its neighbours and then its label's label, so paths shorten by half and
    a star is done in two rounds. Rounds are written to the shared folder; only their number of changes reaches the driver.
    """
    both = common.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    labels = common.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"), F.count("*").alias("times")).withColumnRenamed("a", "node"), "labels", total)
    while True:
        said = labels.select(F.col("node").alias("b"), "label", "times")
        heard = common.join_hot(both, said, ["b"], total, few=common.FEW_NARROW).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(heard, labels["node"] == heard["a"]).select("node", "times", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        known = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        if total <= common.FEW_NARROW:
            joined = near.withColumnRenamed("times", "degree").join(known, "via")
        else:  # many nodes may have one label
            near = common.written(near, "near", total)
            asked = near.groupBy("via").agg(F.count("*").alias("times"))
            joined = common.join_hot(near.withColumnRenamed("times", "degree"), asked.join(known, "via"), ["via"], total, few=common.FEW_NARROW)
        new = common.written(joined.select("node", "old", F.least("via", "jump").alias("label"), F.col("degree").alias("times")), "labels", total)
        labels = new.select("node", "label", "times")
        if new.where("old != label").isEmpty():
            return labels.drop("times")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """What components gives for these edges and those that labels come from: edges that tie two labels are solved among
    themselves, and the labels renamed. Any part of the edges may have one end, and of the nodes one label."""
    total, n = labels.count(), edges.count()
    ends = edges.select("a", "b")
    for side in ("a", "b"):
        asked = ends.groupBy(side).agg(F.count("*").alias("times"))
        known = asked.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}")), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
        ends = common.join_hot(ends, known, [side], n, few=common.FEW_NARROW)
    ties = common.written(ends.where("of_a != of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "ties", n)
    if ties.isEmpty():
        return labels
    top = components(ties)
    nodes = labels.unionByName(top.select("node", F.col("node").alias("label"))).distinct()
    said = nodes.groupBy("label").agg(F.count("*").alias("times")).join(top.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    said = said.withColumn("to", F.coalesce("to", "label"))
    named = common.join_hot(nodes, said, ["label"], total + 2 * n, few=common.FEW_NARROW)
    return common.written(named.select("node", F.col("to").alias("label")), "labels", total + 2 * n)
