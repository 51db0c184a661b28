"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b) of type long; loops of one node keep it.

    Each round hangs every node on the smallest node it knows of, first over all neighbours, then over the smaller ones, so that
    the longest path halves at least; a round is written to shared storage. Smallest neighbours are aggregated before they are joined.
    """
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    now = written(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b") % 1_000_003)).first()
        if after == before:
            break
        before = after
    return nodes.join(now.groupBy("a").agg(F.min("b").alias("b")), nodes["node"] == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
