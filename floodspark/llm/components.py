"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large star: join every larger neighbour of a node to the node's smallest
    neighbour (itself included); small star: the same for its smaller neighbours and itself."""
    if large:
        e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = e.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round is two aggregations and two joins, materialised in the shared folder; the number of
    rounds is logarithmic in the longest path. Ends when a round changes nothing, which is when the
    edges form stars around the smallest nodes.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        e = cut(_star(_star(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.sum("b"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
