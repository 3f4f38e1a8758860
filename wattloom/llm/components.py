"""Connected components of any size: labels spread along the links and along the labels' own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, join_unique, write_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): component is the smallest node that can be reached.

    Each round takes the least label of all neighbours (a partial aggregate, so a node with very
    many links is no burden), then the label of that label; a label that very many nodes have is
    looked up by broadcast. Rounds grow as the logarithm of the longest chain; each is written to the
    shared folder, so that a lost executor costs little.
    """
    both = links.select("a", "b").where("a <> b")
    both = write_table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = write_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    if labels.isEmpty():
        return labels.withColumnRenamed("label", "component")
    often = frequent(both, "a")
    while True:
        near = join_unique(both, labels.withColumnRenamed("node", "a"), "a", often=often).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_near"))
        step = write_table(labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new")), "steps")
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        step = write_table(join_unique(step, jump, "_new").select("node", F.col("_far").alias("label"), (F.col("_far") < F.col("_old")).alias("_moved")), "labels")
        labels = step.select("node", "label")
        if step.where("_moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
