"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.session import materialise


def components(links: DataFrame) -> DataFrame:
    """links has two columns a and b (long); returns node and label, the smallest node that it is connected with.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so that the rounds
    grow with the logarithm of the longest path. Labels stay in tables; the driver sees one count for each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = materialise(low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) as components() gives them, after more links (a, b): only the components that these join are worked on."""
    to = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    pairs = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = components(pairs.where("a <> b").distinct())
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("further"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return materialise(old.unionByName(joined.join(labels, "node", "left_anti")), "labels")
