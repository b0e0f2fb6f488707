"""Bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out


def fold(id_col: str, parts: int) -> Column:
    """A pseudo-random part in [0, parts) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(parts)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label): at most ``per_class`` training rows of each class, taken in the order of a hash of the id.

    Rows of the held-out fold, labels other than 0 and 1, and ids with two
    different labels are left out.  The chosen ids are few enough to broadcast
    (2 * per_class), so the documents are only scanned.  An id that is there
    several times among the documents gives as many rows, so the bound is on
    ids where ids repeat.
    """
    one = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("_other"))
    one = one.filter("label = _other").select("id", "label")
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    chosen = one.filter("label = 0").orderBy(order, "id").limit(per_class).unionByName(one.filter("label = 1").orderBy(order, "id").limit(per_class))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id")
