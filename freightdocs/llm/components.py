"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightdocs.llm.common import written


def components(links: DataFrame, name: str) -> DataFrame:
    """``(node, component)`` for every node in ``links(a, b)``; component = smallest node that can be reached.

    Each round lowers the label of a node to the smallest among its neighbours, and then to that label's own
    label, so long chains shorten by halves. A round is one written table: nothing is kept in executors, and no
    link or label comes to the driver, only the number of labels that changed. Links of a node with very many
    neighbours are split by AQE, as they are only joined and reduced by ``min``, which combines before its shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    labels = written(labels.withColumn("changed", F.lit(True)), f"{name}-labels")
    while labels.filter("changed").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        low = near.unionByName(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = low.join(jump, "low", "left").select("node", F.least("low", "far").alias("component"))
        old = labels.select("node", F.col("component").alias("was"))
        labels = written(new.join(old, "node").select("node", "component", (F.col("component") != F.col("was")).alias("changed")),
                         f"{name}-labels")
    return labels.select("node", "component")
