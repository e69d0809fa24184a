"""Connected components of an edge table, by alternating stars on Spark: labels only ever live in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.session import cut


def one_star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its smallest neighbour (itself included) to the neighbours on one side of it: larger ones, or the rest and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low"))
    joined = both.join(least, both["a"] == least["node"])
    if large:
        pairs = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        pairs = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (columns a, b): the smallest node that can be reached.

    Large-star and small-star steps in turn until nothing changes; a few rounds for any shape (about the log of the node count).
    Each round is a written table, so a lost executor costs one round.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = cut(one_star(one_star(now, large=True), large=False))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
