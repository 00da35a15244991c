"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component): each linked node with the smallest node reachable from it.

    Each round hangs a node's larger neighbours (large star) or its smaller ones
    (small star) on the smallest node of its neighbourhood, until nothing moves.
    Neighbourhood minima are aggregates joined back to the links, so a hub's links
    are never gathered in one task: the aggregate is combined before the shuffle
    and AQE splits the join. Rounds end in ``checkpoint()``. Self-links and nulls
    drop out; no links give no rows.
    """
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a > b").distinct().checkpoint()
    seen = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").unionAll(lows.select("a", F.col("low").alias("b"))).distinct()
        edges = small.checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
