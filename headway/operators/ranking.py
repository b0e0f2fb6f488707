"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """rows with ``name``, their place from 0 in their group in the order given; no order values repeat in a group.

    Rows are sorted across tasks by ranges, so that a large group lies in many
    tasks.  Each task numbers what it has; the rows of a group in the tasks
    before, a running sum over one row for each task and group, are added.
    """
    by = [*group, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    placed = scratch.write(dealt.withColumn("_task", F.shiftright("_row", 33)))
    counts = placed.groupBy(*group, "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(shifts, [*group, "_task"]).withColumn(name, (F.col("_row") + F.col("_shift")).cast("int")).drop("_row", "_task", "_shift")
