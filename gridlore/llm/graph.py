"""Connected components as DataFrame steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b).

    Alternates the large-star and small-star steps until the edges are stars;
    each step is one aggregation and one join, and the number of rows never
    exceeds that of the edges.  Hubs are pre-aggregated before the shuffle.
    """
    now = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), label)
    state = None
    while True:
        # large star: every neighbour above u goes to the least of u's neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = stash(large, label)
        # small star: every neighbour below u, and u, go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()
        small = stash(small, label)
        seen = small.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.bit_xor(F.xxhash64("b", "a")).alias("g")).first()
        discard(now, large)
        now = small
        if tuple(seen) == state:
            break
        state = tuple(seen)
    heads = now.select(F.col("a").alias("node")).distinct()
    return heads.select("node", F.col("node").alias("component")).union(now.select(F.col("b").alias("node"), F.col("a").alias("component")))
