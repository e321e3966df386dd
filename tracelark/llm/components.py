"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROWS = 200_000  # edges that one task writes


def _stars(edges: DataFrame) -> bool:
    """True if every edge (u, v) leads a node with no other edge to a centre that leads nowhere."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node that stands in a link (u, v): the label is the component's smallest node.

    Minima are pre-aggregated before they shuffle and are written before they are joined back, so the hub of a large star
    is a splittable key; every round is cut by a written table, and the rounds grow with the logarithm of the longest path.
    Tables of few edges are written by few tasks.
    """
    edges = scratch.table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    parts = edges.count() // ROWS + 1

    def write(df: DataFrame) -> DataFrame:
        return scratch.table(df.coalesce(parts))

    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = write(large.groupBy("u").agg(F.min("v").alias("m")))
        down = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = write(down.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for old in (edges, least, large, low):
            scratch.drop(old)
        edges = new
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
