"""CSV files as rows of text, read by many tasks whether or not quoted values hold line breaks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Scratch

#: Whole fields up to the end of a line, from a field's start: quoted ones, in which a quote is doubled, and others, in which quotes mean nothing.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|)'
_FIELDS = rf"{_FIELD}(?:,{_FIELD})*+$"

#: Rows of a split that one window takes at most, as a power of two.
PART_BITS = 17


class CsvError(ValueError):
    """A file is no CSV."""


def _ends(value: Column) -> tuple[Column, Column]:
    """Whether a line ends inside quotes (1) or not (0): if it begins outside of them, and if it begins inside."""
    plain = ~F.contains(value, F.lit('"'))
    outside = F.when(plain | F.rlike(value, F.lit(f"^{_FIELDS}")), 0).otherwise(1)
    inside = F.when(plain, 1).when(F.rlike(value, F.lit(rf'^{_QUOTED}"[^,]*+(?:$|,{_FIELDS})')), 0).otherwise(1)
    return outside, inside


def _states(rows: DataFrame, order) -> DataFrame:
    """rows (e0, e1, ...) with the state before each, at0 and at1, and after, after0 and after1, for both states before the window.

    A row, which maps 0 to e0 and 1 to e1, keeps the state, turns it, or sets
    it whatever it was: so the state is what the last row that sets it sets,
    turned as often as rows turn it from there on, which running sums give.
    """
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_turns", F.sum(F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0)).over(so_far))
    rows = rows.withColumn("_sets", F.last(F.when(F.col("e0") == F.col("e1"), F.col("e0") - F.col("_turns")), ignorenulls=True).over(so_far))
    rows = rows.withColumns({f"after{s}": F.pmod(F.coalesce("_sets", F.lit(s)) + F.col("_turns"), F.lit(2)).cast("int") for s in (0, 1)}).drop("_turns", "_sets")
    return rows.withColumns({f"at{s}": F.coalesce(F.lag(f"after{s}").over(order), F.lit(s)) for s in (0, 1)})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a file, or of a folder of files with the same columns, as text under the names of the first line, and ``_ord``.

    _ord follows the files' names, and the lines in each.  Values that are
    missing or empty are null.  A quoted value may hold commas, doubled quotes
    and line breaks; a quote inside another value is a letter.  Blank lines
    are left out.  A file whose last quote is never closed is an error.  An
    empty file has no columns.

    Files are split anywhere: a first look tells each split's place and
    whether any line that begins outside quotes ends inside them; if none
    does, every line is a record.  Else each line is told from running sums in
    its part of a split and over all parts where its record begins; records of
    several lines are then gathered, and all are parsed where they are.
    """
    scratch = Scratch(spark, "csv")
    outside, _ = _ends(F.col("value"))
    # Written, so that splits and the rows in them stay as they were first numbered.
    lines = scratch.write(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"),
        F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("value"), outside.alias("e0"),
    ))
    said = F.trim("value") != ""
    splits = scratch.write(lines.groupBy("file", "split").agg(F.max(F.col("e0") == 1).alias("quotes"), F.min(F.when(said, F.col("row"))).alias("head")))
    first = splits.filter("split = 0 and head is not null").orderBy("file").first()
    if first is None:
        return spark.createDataFrame([], "_ord long")
    names = lines.filter((F.col("row") == first.head) & (F.col("file") == first.file)).first().value
    names = [c.strip().lstrip("﻿") for c in next(csv.reader([names]))]
    # One row for each split of the table.
    splits = splits.withColumn("place", F.row_number().over(Window.orderBy("file", "split")) - 1)
    head = F.when(F.col("split") == 0, F.col("head"))
    lines = lines.join(splits.select("file", "split", "place", head.alias("head")), ["file", "split"])
    lines = lines.withColumn("_ord", F.shiftleft(F.col("place").cast("long"), 33) + F.col("row").bitwiseAND((1 << 33) - 1)).withColumn("head", F.coalesce(F.col("row") == F.col("head"), F.lit(False)))
    records = lines.select("_ord", "head", "value") if splits.filter("quotes").isEmpty() else _records(lines, scratch)
    own = [f"c{k}" for k in range(len(names))]
    # The values of a header are null, whatever Spark computes from them before it leaves the row out.
    kept = said & ~F.col("head")
    parsed = F.when(kept, F.from_csv("value", ", ".join(f"{c} string" for c in own), {"escape": '"', "mode": "PERMISSIVE"}))
    # By a generator, so that a row is parsed once, however often its values are used and filters on them are moved.
    rows = records.filter(kept).select("_ord", F.inline(F.array(parsed)))
    return rows.select("_ord", *[F.col(c).alias(name if name not in names[:k] else f"{name}_{k}") for k, (c, name) in enumerate(zip(own, names, strict=True))])


def _records(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(_ord, head, value) of the records of lines (file, split, row, value, e0, _ord, head)."""
    # A split is cut into parts of so many rows, as a window holds all of its rows at once.
    lines = lines.withColumns({"e1": _ends(F.col("value"))[1], "part": F.shiftright("row", PART_BITS)})
    place = ["file", "split", "part"]
    in_split = Window.partitionBy(*place).orderBy("row")
    # The record of a line is the last that began up to it, for both states before the part.
    begun = {f"record{s}": F.last(F.when(F.col(f"at{s}") == 0, F.col("_ord")), ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, 0)) for s in (0, 1)}
    known = scratch.write(_states(lines, in_split).withColumns(begun))
    # What a part does to the state as a whole, and so the state that each part begins in; and the last record that began in it, or in a part before.
    whole = known.groupBy(*place).agg(F.max(F.col("row") * 4 + F.col("after0") * 2 + F.col("after1")).alias("ends"), *[F.max(f"record{s}").alias(f"record{s}") for s in (0, 1)])
    whole = whole.withColumns({"e0": F.shiftright("ends", 1).bitwiseAND(1), "e1": F.col("ends").bitwiseAND(1)})
    in_file = Window.partitionBy("file").orderBy("split", "part")
    last = F.when(F.col("at0") == 0, F.col("record0")).otherwise(F.col("record1"))
    whole = _states(whole, in_file).select(*place, F.col("at0").alias("open"), F.col("after0").alias("still_open"), F.last(last, ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = scratch.write(whole)
    if bad := whole.groupBy("file").agg(F.max_by("still_open", F.struct("split", "part")).alias("open")).filter("open = 1").first():
        raise CsvError(f"a quote is never closed: {bad.file}")
    by_open = lambda c: F.when(F.col("open") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    told = known.join(whole, place).select("_ord", "head", "value", ((F.col("e0") == 0) & (by_open("at") == 0)).alias("alone"), F.coalesce(by_open("record"), "carried").alias("record"))
    joined = told.filter("not alone").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("_ord", "value"))).alias("parts"), F.max("head").alias("head"))
    return told.filter("alone").select("_ord", "head", "value").unionByName(joined.select(F.col("record").alias("_ord"), "head", F.array_join("parts.value", "\n").alias("value")))
