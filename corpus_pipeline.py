"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the docs of the next.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import Scratch, table
from headway.llm.exact_dedup import drop_exact_duplicates
from headway.llm.mixing import mixed_documents
from headway.llm.ngram_join import keep_one_of_each
from headway.llm.packing import pack
from headway.llm.quality import keep_good

#: Share of the tokens that reach the mixing stage which it hands on; a leaf short of documents is read up to twice.
MIX_FRACTION, MIX_EPOCHS = 0.8, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    A null text is scored as an empty one; null ids and rows repeated in full
    are scored like others.  An empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id (nulls last).

    Null and empty texts are equal; of rows repeated in full one stays.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (nulls last).

    Texts without words are near nothing; of rows repeated in full, or of one
    id and text, one stays.
    """
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target proportions of domains, languages and sources; one taken in two epochs is there twice.

    A null text has no words and costs nothing; a null language or source is
    a leaf of its own; ties in an epoch's order go by hash.
    """
    return mixed_documents(docs, fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; ids are little-endian unsigned 32-bit numbers.

    A null or empty text is its closing id alone; null ids and repeated rows
    are documents like others.
    """
    return pack(docs).withColumnRenamed("id", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing),
]

#: Compression and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
