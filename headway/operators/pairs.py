"""Pairs of stops drawn at random, any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .ranking import ranked


def _draw(seed: int, side: str, number: Column) -> Column:
    """A number from 0 to 2^60 - 1 that the seed, the side and the pair's number alone determine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{side}:"), number.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def random_pairs(stops: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(query_id, origin, target): n pairs of different stops out of stops (stop_id), each drawn on its own; none if there are fewer than two stops.

    Each pair looks two ranks up in a table of the stops in their order, so
    pairs can be more than stops, and any part of them can be made anywhere.
    """
    scratch = Scratch(stops.sparkSession, "pairs")
    table = scratch.write(ranked(stops.select("stop_id").distinct(), [], ["stop_id"], "k", scratch))
    size = table.count()
    if size < 2:
        return table.select(F.lit(0).cast("long").alias("query_id"), F.col("stop_id").alias("origin"), F.col("stop_id").alias("target")).limit(0)
    i = F.col("id")
    a, other = _draw(seed, "origin", i) % size, _draw(seed, "target", i) % (size - 1)
    drawn = stops.sparkSession.range(n).select(i.alias("query_id"), a.alias("a"), other.alias("b")).withColumn("b", F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0))
    out = drawn.join(table.select(F.col("k").cast("long").alias("a"), F.col("stop_id").alias("origin")), "a")
    return out.join(table.select(F.col("k").cast("long").alias("b"), F.col("stop_id").alias("target")), "b").select("query_id", "origin", "target")
