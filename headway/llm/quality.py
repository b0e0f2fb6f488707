"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held_out, small_batches, table, whole_rows
from .labelled import fold, labelled_sample

#: Labelled rows that a fit uses at most, of each class.
SAMPLE_PER_CLASS = 8000
#: Texts that each dictionary is trained on at most, and the most successive characters of one of them, from a place that its hash decides.
DICTIONARY_TEXTS, DICTIONARY_TEXT_CHARS = 1000, 2500
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bytes of typical text that each text's difference is averaged with, so that a few words prove nothing.
SHRINK_BYTES = 50


def _dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; with too few texts to train one, the texts themselves serve as it."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    typical: float
    #: None if the labels lack a class; every score is then ``prior``.
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(doc, n_bytes, size_good, size_bad, difference, score), one row for each row of docs; doc holds its columns.

        Null texts count as empty; an empty text has the difference ``typical``.
        """
        out = _measured(whole_rows(docs), text_col, self.good, self.bad)
        out = out.withColumn("difference", _difference(self.typical))
        if self.calibration is None:
            return out.withColumn("score", F.lit(self.prior))
        return self.calibration.transform(out).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


MEASURES = ("n_bytes", "size_good", "size_bad")


def _difference(typical: float) -> Column:
    return (F.col("size_bad") - F.col("size_good") + SHRINK_BYTES * typical) / (F.col("n_bytes") + SHRINK_BYTES)


def _measured(rows: DataFrame, text_col: str, good: bytes, bad: bytes) -> DataFrame:
    """rows (doc) with MEASURES: the bytes of each whole text in doc, and its size compressed with either dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]
        for batch in batches:
            sizes = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(pc.struct_field(batch.column("doc"), [at]).cast(pa.large_string()).cast(pa.large_binary())):
                b = text.as_buffer() if text.is_valid else b""
                sizes[:, k] = (len(b), *(len(c.compress(b)) if len(b) else 0 for c in made))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, sizes)], ["doc", *MEASURES])

    at = [c.lower() for c in rows.schema["doc"].dataType.names].index(text_col.lower())
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Fit on at most 2 * per_class labelled rows of the training fold.

    One half (by a hash of the id) gives the dictionaries, of each class at
    most DICTIONARY_TEXTS texts in the order of another hash, and of a long
    text DICTIONARY_TEXT_CHARS characters: no more reaches the driver.  On the other the
    difference of compressed sizes, per byte of text, is calibrated by
    isotonic regression, with classes weighted back to their shares among all
    training labels.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.write(labelled_sample(docs, labels, label, per_class, id_col, text_col))
    shares = {r["label"]: r["n"] for r in labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    order = F.xxhash64(F.lit("dictionary"), F.col("id"), F.col("text"))
    begin = 1 + F.pmod(order, F.greatest(F.length("text") - DICTIONARY_TEXT_CHARS + 1, F.lit(1))).cast("int")
    passages = sample.filter((fold("id", 2) == 0) & (F.col("text") != "")).select("label", order.alias("order"), F.substring(F.col("text"), begin, F.lit(DICTIONARY_TEXT_CHARS)).alias("passage"))
    texts = {k: [r["passage"].encode() for r in passages.filter(F.col("label") == k).orderBy("order", "passage").limit(DICTIONARY_TEXTS).collect()] for k in (0, 1)}
    counts = {r["label"]: r["n"] for r in sample.filter(fold("id", 2) == 1).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not texts[0] or not texts[1] or len(counts) < 2:
        return QualityModel(b"", b"", 0.0, None, prior)
    good, bad = _dictionary(texts[1]), _dictionary(texts[0])
    rest = sample.filter(fold("id", 2) == 1)
    weight = F.when(F.col("label") == 1, shares[1] / counts[1]).otherwise(shares[0] / counts[0])
    rows = whole_rows(rest.select("text", F.col("label").cast("double").alias("label"), weight.alias("weight")))
    measured = scratch.write(_measured(rows, "text", good, bad).select("doc.label", "doc.weight", *MEASURES))
    typical = measured.filter("label = 1").agg(F.percentile_approx((F.col("size_bad") - F.col("size_good")) / (F.col("n_bytes") + 1), 0.5)).first()[0]
    train = measured.select(_difference(typical).alias("difference"), "label", "weight")
    calibration = IsotonicRegression(featuresCol="difference", labelCol="label", weightCol="weight", predictionCol="score").fit(train)
    return QualityModel(good, bad, typical, calibration, prior)


#: Scores from here on count as good.
THRESHOLD = 0.3


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, with docs' columns."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    return model.score(docs, text_col).filter(F.col("score") >= threshold).select("doc.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = fit_quality(docs, table(spark, sf_dir, "labels")).score(docs.select("doc_id", "text"))
    doc_id = F.col("doc.doc_id")
    return scored.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference", *MEASURES)


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
