"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge; a component is named by its smallest node.

    Each round takes a node's label to the least among its neighbours', and then to that label's own
    label; the rounds are about the logarithm of the longest path. Labels are written to the shared
    folder after each, so lineage stays short. A node with any number of edges is no problem:
    least labels are taken before the shuffle too.
    """
    both = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).where("a != b").distinct(), "edges")
    labels = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label"))
        least = both.join(of_b, "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        new = labels.join(least, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = settled(new.join(jump, "next").select("node", F.col("label").alias("old"), F.least("next", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels.withColumnRenamed("label", "component")
