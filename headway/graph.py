"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all ends of edges (a, b); a component is named by its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones,
    under its smallest neighbour; the number of edges never grows, and rounds
    grow with the logarithm of a component's size.  A node's neighbours are
    reduced to a minimum in each task first.  The minima are written before
    they are joined with: so both sides of the join come from tables, and
    Spark can split the edges of one node over several tasks.
    """
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # An edge is hung from both its ends; each row here is one of the two.
        large = scratch.write(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.withColumnRenamed("m", "v"))
        after = scratch.write(small.distinct())
        for df in (now, least, large, lower):
            scratch.drop(df)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
