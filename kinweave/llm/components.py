"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the smallest node of its component.

    Each round joins edges with one minimum per node, so a hub's edges spread over tasks (Spark splits skewed
    joins); nothing is gathered per component. Loops and repeated edges do no harm; null ends are dropped.
    """

    def down(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    # The minima's key under another value: their sum does not fix the join's exchange then, and a hub's edges can split.
    apart = F.bitwise_not("a").alias("na")
    e = common.cut(down(edges))
    before = None
    while before != (before := state(e)):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(apart, F.least("a", "m").alias("m"))
        large = down(both.join(low, F.bitwise_not("a") == F.col("na")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = low.select(apart, "m")
        small = large.join(near, F.bitwise_not("a") == F.col("na")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = common.cut(down(small.union(low.select("a", F.col("m").alias("b")))))
    tails = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tails.union(e.select("b", "b").distinct())
