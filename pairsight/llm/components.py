"""Connected components by rounds of star edges, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node reachable, for every node of edges (a, b); a node without edges isn't in it.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest it knows, so paths shorten
    by a factor a round and a node with many neighbours is only ever the key of an aggregation. Rounds are
    checkpointed. Rows that repeat, loops and null nodes count for nothing.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
