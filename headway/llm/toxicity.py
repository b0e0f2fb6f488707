"""Toxicity classifier: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held_out, small_batches, table
from .labelled import fold, labelled_sample
from .words import slices, split_words

#: Labelled rows that a fit uses at most, of each class.
SAMPLE_PER_CLASS = 6000
#: Terms in the lexicon at most; in how many toxic texts a term must be; and its least log odds.
LEXICON_TERMS, LEXICON_DOCS, LEXICON_ODDS = 4000, 3, 2.0
#: Lengths of the word beginnings that are terms besides whole words.
STEMS = (4, 5, 6)
#: Words on either side that count as near.
NEAR = 5
TREES, DEPTH = 20, 3
THRESHOLD = 0.5
EDGE = ".,;:!?\"'()[]{}*#%&$-_|<>/\\«»¡¿…"
#: Digits and signs that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$!", "oieastbasi", "*.-_'")
SECOND_PERSON = frozenset(
    "you your yours yourself u ur you're du dich dir dein deine deinen deiner euch ihr sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros os"
    .split()
)
#: Insults that are in every lexicon, whatever the labels show, with SEED_ODDS.
SEED_TERMS = frozenset(
    "idiot idiots moron morons imbecile stupid dumb dumbass loser losers scum trash garbage filth worthless pathetic disgusting clown freak pig vermin bastard bitch asshole retard"
    " idioten dumm dummkopf trottel arschloch abschaum wertlos widerlich versager schwein hurensohn"
    " imbécile connard connasse salaud débile ordure minable pathétique crétin abruti"
    " imbécil estúpido estúpida escoria basura patético patética gilipollas cabrón asqueroso inútil".split()
)
SEED_ODDS = 3.0
FEATURES = (
    "n_words", "hits", "hit_density", "odds_density", "most_odds", "distinct_density", "disguised_density",
    "second_person", "near_second_person", "capitals", "exclamations", "punctuation", "obfuscation",
)


def _terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)] if len(word) > 2 else []


def _plain(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), EDGE)


def _word_odds(word: str, lexicon: dict[str, float]) -> tuple[float, float]:
    """The highest log odds of the word's terms, and of its undisguised form's if it is disguised."""
    plain = max((lexicon.get(t, 0.0) for t in _terms(word)), default=0.0)
    bare = word.translate(DISGUISE)
    return plain, max((lexicon.get(t, 0.0) for t in _terms(bare)), default=0.0) if bare != word else 0.0


def _features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words, counts = split_words(texts)
    n, total = len(texts), len(words)
    coded = _plain(words).dictionary_encode()
    own = coded.dictionary.to_pylist()
    odds_of = np.array([_word_odds(w, lexicon) for w in own], float).reshape(-1, 2)
    which = coded.indices.to_numpy() if total else np.zeros(0, int)
    you = np.array([w in SECOND_PERSON for w in own], bool)[which] if total else np.zeros(0, bool)
    plain, bare = (odds_of[which, k] if total else np.zeros(0) for k in (0, 1))
    odds = np.maximum(plain, bare)
    hit, row = odds > 0, np.repeat(np.arange(n), counts)
    add = lambda x: np.bincount(row, weights=x, minlength=n)
    seen = np.concatenate([[0], np.cumsum(you)])
    last = np.repeat(np.cumsum(counts), counts)
    first, at = last - np.repeat(counts, counts), np.arange(total)
    near = seen[np.minimum(at + NEAR + 1, last)] > seen[np.maximum(at - NEAR, first)]
    most = np.zeros(n)
    np.maximum.at(most, row, odds)
    pairs = np.unique(row[hit].astype(np.int64) * max(len(own), 1) + which[hit]) // max(len(own), 1)
    size, chars = np.maximum(counts, 1), np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    share = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / chars
    hits = add(hit)
    return np.column_stack([
        np.log1p(counts), np.log1p(hits), hits / size, add(odds) / size, most, np.bincount(pairs, minlength=n) / size, add(bare > 0) / size,
        add(you) / size, add(hit & near) / np.maximum(hits, 1), share(r"\p{Lu}"), share("!"), share(r"[[:punct:]]"), share(r"[A-Za-z][0-9@$*!]+[A-Za-z]"),
    ])


def _featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """rows with FEATURES instead of text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = _features(part.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *(pa.array(c) for c in x.T)], [*kept, *FEATURES])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(f, T.DoubleType()) for f in FEATURES)]))


def fit_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and their log odds, from the texts (text, label) of a bounded sample; a term counts once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, labels = [], []
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                words, _ = split_words(pa.array([text.as_py()], pa.large_string()))
                terms = {t for w in _plain(words).unique().to_pylist() for t in _terms(w)}
                found += terms
                labels += [label] * len(terms)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], ["term", "label"])

    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "term string, label int").groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("c") + 0.5) / (n.get(0, 0) + 1.0))
    best = counted.filter(F.col("t") >= LEXICON_DOCS).select("term", "t", odds.alias("odds")).filter(F.col("odds") >= LEXICON_ODDS)
    learned = {r["term"]: r["odds"] for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").limit(LEXICON_TERMS).collect()}
    return dict.fromkeys(SEED_TERMS, SEED_ODDS) | learned


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    #: None if the labels lack a class; every score is then ``prior``.
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, FEATURES..., margin, score), one row for each row of docs.  Null texts count as empty, whose features are all zero."""
        out = _featured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), self.lexicon)
        if self.trees is None:
            return out.select("*", F.lit(0.0).alias("margin"), F.lit(self.prior).alias("score"))
        scored = self.calibration.transform(_margins(self.trees, out))
        return scored.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def _margins(trees: GBTClassificationModel, featured: DataFrame) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)
    return trees.transform(assembled).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Fit on at most 2 * per_class labelled rows of the training fold.

    By a hash of the id these fall into four parts.  The lexicon comes from
    all of them, but the features that the trees and the calibration learn
    from are counted with the lexicon of the other two parts: parts 0 and 2
    train the trees, 1 and 3 calibrate their margins, weighted back to the
    classes' shares among all training labels.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(labelled_sample(docs, labels, label, per_class, id_col, text_col).withColumn("part", fold("id", 4)))
    shares = {r["label"]: r["n"] for r in labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    counts = {(r["odd"], r["label"]): r["n"] for r in sample.groupBy((F.col("part") % 2).alias("odd"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 4:
        return ToxicityModel({}, None, None, prior)
    halves = [sample.filter("part < 2"), sample.filter("part >= 2")]
    crossed = [_featured(own.select("text", "part", F.col("label").cast("double").alias("label")), fit_lexicon(other)) for own, other in (halves, halves[::-1])]
    featured = scratch.write(crossed[0].unionByName(crossed[1]))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured.filter("part % 2 = 0"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(assembled)
    weight = F.when(F.col("label") == 1, shares[1] / counts[1, 1]).otherwise(shares[0] / counts[1, 0])
    margins = _margins(trees, featured.filter("part % 2 = 1")).select("margin", "label", weight.alias("weight"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(margins)
    return ToxicityModel(fit_lexicon(sample), trees, calibration, prior)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "margin", *FEATURES
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
