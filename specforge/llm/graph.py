"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(pairs: DataFrame, smaller: bool) -> DataFrame:
    """Each node hands its neighbours (only smaller ones, itself included, for the small star) to the least of them."""
    least = F.least(F.col("node"), F.min("other"))
    if smaller:
        low = pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        minima = low.groupBy("node").agg(least.alias("m"))
        linked = low.join(minima, "node").select(F.col("other").alias("a"), F.col("m").alias("b")).union(minima.select(F.col("node").alias("a"), F.col("m").alias("b")))
    else:
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        minima = both.groupBy("node").agg(least.alias("m"))
        linked = both.filter("other > node").join(minima, "node").select(F.col("other").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (a, b); ends when a round changes nothing.

    A hub with very many neighbours is never collected: only minima are aggregated, and they combine before a shuffle.
    """
    now = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = staged(_star(_star(now, False), True), "edges")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
