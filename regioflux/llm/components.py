"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm.storage import drop, written


def _hooked(edges: DataFrame, keep) -> DataFrame:
    """Every edge (u, v) that keep selects, hooked to the least neighbour of u (or u itself, if less)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link, component being the least node it can reach.

    Each round hooks nodes to smaller neighbours until all edges lead straight to the least node; rounds grow with the logarithm of
    the longest path. Every round is written to the shared folder. No links, self-links and repeated links are fine.
    """
    first = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = written(first, "edges")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, F.col("v") > F.col("u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.filter("u <> v").distinct(), "edges")
        drop(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
