"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(pairs: DataFrame, smaller: bool) -> DataFrame:
    """One step over directed pairs (u, v): every kept neighbour of u, and u itself, is tied to the least of them.

    The least neighbour is an aggregate with partial sums and the tie a join on u, so a hub is no single task's work.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = pairs.join(least, "u")
    if smaller:
        return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
    return tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, component (its least node) of every node of the undirected edges (a, b). Each step is written to the shared folder."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/cc0")
    state, step = None, 0
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(told) == state or not told[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state, step = tuple(told), step + 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stored(_star(both, False), f"{folder}/cc{step}l")
        now = stored(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True), f"{folder}/cc{step}s")
