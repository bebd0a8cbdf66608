"""Connected components of an edge table, by stars that contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge the least of a and all its neighbours. The aggregate combines on the map side, and the join
    back is one that adaptive execution can split, so a node with very many neighbours is no bottleneck."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    return edges.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the edges (a, b); loops and repeats are fine.

    Each round hangs the larger neighbours of a node, and then its smaller ones, under the least of them. The rounds
    needed grow with the logarithm of the longest path. An empty edge table has no nodes.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        large = _with_least(_both_ways(now)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = _with_least(large)
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = cut_lineage(small.where("a <> b").distinct())
        moved = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        now = after
        if moved:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
