"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm.storage import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (large) or smaller (small) neighbours of each node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # written, so that the join's two sides are plain exchanges and a hub's neighbours can be split over tasks
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    tied = both.join(least, "a")
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), integers; root is the component's smallest node.

    Each step only joins edges with one row per node, so a node with very many neighbours
    is a large join key and never one group in memory; the number of steps grows with the
    logarithm of the longest path. Null ends and loops are no edges, repeated edges
    count once, an empty table gives no rows.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropna().filter("a > b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = written(_stars(_stars(now, True), False), "edges")
    # what is left are stars around the roots
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
