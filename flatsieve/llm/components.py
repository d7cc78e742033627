"""Connected components of a graph given as an edge table, by alternating star operations.

Large-star links every larger neighbour of a node to the least node around it, small-star every
smaller one; repeated, every component becomes a star around its least node, in a number of rounds
that grows with the logarithm of its size. Each round is two aggregations and two joins over the
distinct edges, written to the shared scratch folder; nothing but a count and a checksum comes to
the driver. Hubs cost a row for each edge: minima are combined before the shuffle, and the
joins by node are ones that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b, moved to the least node around each node."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = around.join(least, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b): component is the least node that it reaches.

    Edges that join a node to itself or repeat are allowed; an empty table gives an empty result.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    seen = sign(now)
    while seen[0]:
        then = scratch.write(_star(_star(now, True), False), "stars")
        new = sign(then)
        scratch.drop(now)
        now = then
        if new == seen:
            break
        seen = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
