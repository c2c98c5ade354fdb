"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, cut


HEAVY = 512  # neighbours from which a node is joined by broadcast


def _star(edges: DataFrame) -> DataFrame:
    """Hang each end of an edge under the least node around the other end, where that is smaller."""
    both = edges.union(edges.select("b", "a"))
    least = cut(both.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n")).select(F.col("a").alias("_u"), F.least("a", "_m").alias("_m"), "_n"))
    met = lambda rows, to: rows.join(to.drop("_n"), F.col("a") == F.col("_u"))
    # The neighbours of a hub do not meet in one task.
    heavy = bounded(cut(least.where(F.col("_n") > HEAVY)))
    if heavy.limit(1).count():
        light = both.join(heavy.select("_u"), F.col("a") == F.col("_u"), "left_anti")
        seen = met(both, heavy).union(met(light, least))
    else:
        seen = met(both, least)
    large = seen.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
    # Every edge now points to a smaller node; small star joins each node's targets under the least.
    low = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_u")
    joined = large.join(low, F.col("a") == F.col("_u"))
    return (
        joined.select(F.col("b").alias("a"), F.col("_m").alias("b"))
        .union(low.select(F.col("_u").alias("a"), F.col("_m").alias("b")))
        .where("a <> b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``edges(a, b)``; a component is named by its least node.

    No adjacency is gathered anywhere: minima are pre-aggregated and joined
    back. The edges are written after each round, and the number of rounds
    grows with the logarithm of the longest chain.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == mark:
            break
        mark = tuple(sign)
        now = cut(_star(now))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
