"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..checkpoints import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node of its component.

    Each round a node takes the least label next to it and then the label of its label, so long chains shorten by half;
    rounds go on until no label changes. Nothing is gathered per component.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    mark, before = F.expr("bit_xor(xxhash64(node, label))"), None
    while before != (before := labels.agg(mark).first()[0]):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))  # labels only fall: the last round's do as well
        labels = cut(low.join(up, F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")))
    return labels
