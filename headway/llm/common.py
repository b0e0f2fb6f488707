"""Small helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, shared_folder

__all__ = ["SPACE", "Scratch", "held_out", "shared_folder", "small_batches", "table", "text_or_empty", "whole_rows"]

#: White space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """docs' columns as one struct, doc, and columns beside it, whose names then can't clash with theirs; doc.* gives them back."""
    return docs.select(F.struct("*").alias("doc"), *more)


def held_out(doc_id: str | Column) -> Column:
    """The evaluation fold: rows whose labels no model may learn from."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task is sent at once by bytes, so that its memory does not depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
