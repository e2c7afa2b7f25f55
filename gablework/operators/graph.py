"""Connected components by labels that travel and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, class_id): the least node each node is connected with. Nodes without a pair are not in it.

    Least labels travel along edges and jump to their own label's label, so that a chain takes a logarithm of its length in rounds.
    """
    edges = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")))
    for _ in range(most_rounds):
        across = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("class_id").alias("seen"))
        new = labels.join(across.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("class_id", "seen").alias("class_id"), F.col("class_id").alias("old"))
        hop = new.select(F.col("node").alias("via"), F.col("class_id").alias("further"))
        new = new.join(hop, new.class_id == hop.via, "left").select("node", F.least("class_id", "further").alias("class_id"), "old")
        new = cut(new)
        labels = new.select("node", "class_id")
        if new.filter("class_id <> old").isEmpty():
            return labels
    raise ValueError(f"labels still change after {most_rounds} rounds")
