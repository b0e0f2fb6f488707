"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, text_or_empty, whole_rows

SEED = 17
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """The domain of a source: by the last digit of its name, "web" (0-4), "books" (5-7) or "reference"; null is "unknown"."""
    digit = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(source.isNull(), "unknown").when(digit.between("0", "4"), "web").when(digit.between("5", "7"), "books").otherwise("reference")


#: Weights of domains, of languages in each domain, and of sources in each language; any other child weighs OTHER.
WEIGHTS = {"domain": {"web": 5.0, "books": 3.0, "reference": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {}}
OTHER = 1.0


def token_count(text_col: str) -> Column:
    """Words of the whole text."""
    trimmed = F.regexp_replace(text_or_empty(text_col), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE, -1))).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    known = [x for k, w in weights.get(level, {}).items() for x in (F.lit(k), F.lit(float(w)))]
    return F.coalesce(F.element_at(F.create_map(*known), F.col(level)), F.lit(OTHER)) if known else F.lit(OTHER)


def _share(nodes: DataFrame, parent: list[str], order: str) -> DataFrame:
    """nodes with ``budget``: each parent's ``parent_budget`` shared out among its children by weight.

    A child gets at most its capacity; what it can't use goes to its siblings
    in proportion to their weights.  Children are filled in the order of
    capacity per weight: child i is full if its capacity is at most its share
    of what the fuller ones leave.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    nodes = nodes.withColumn("rate", left / F.sum("weight").over(upto)).withColumn("full", F.col("capacity") <= F.col("weight") * F.col("rate"))
    # Once one child is not full, all after it aren't, and they share at its rate.
    first_rate = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * first_rate)).drop("rate", "full", "parent_budget")


def budgets(leaves: DataFrame, total: float | None, fraction: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(domain, lang, source, tokens, budget): how many tokens to take of each leaf.

    A leaf's capacity is its tokens times max_epochs.  The tree is walked from
    the root; a node whose subtree can't use its share leaves the rest to its
    siblings, so shortages stay as low in the tree as they can.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    whole = leaves.agg(F.least(F.lit(total), F.sum("capacity")) if total is not None else F.sum("tokens") * F.lit(float(fraction))).first()[0] or 0.0
    whole = float(whole)
    top = domains.withColumn("weight", _weight("domain", weights)).withColumn("parent_budget", F.least(F.lit(whole), F.sum("capacity").over(Window.partitionBy(F.lit(1))))).withColumn("root", F.lit(1))
    top = _share(top, ["root"], "domain").select(F.col("domain").alias("d"), F.col("budget").alias("parent_budget"))
    mid = langs.withColumn("weight", _weight("lang", weights)).join(top, F.col("domain").eqNullSafe(F.col("d"))).drop("d")
    mid = _share(mid, ["domain"], "lang").select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("budget").alias("parent_budget"))
    low = leaves.withColumn("weight", _weight("source", weights)).join(mid, F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).drop("d", "l")
    return _share(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def mix(
    docs: DataFrame, total: float | None = None, fraction: float = 0.5, max_epochs: int = 2, weights: dict[str, dict[str, float]] = WEIGHTS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(id, key, domain, lang, source, n_tokens, epoch, n_rows): each document taken, once for each epoch that takes it.

    The budget is ``total`` tokens, or ``fraction`` of all, at most what
    max_epochs give.  An epoch orders a leaf's documents by the MD5 of seed,
    epoch, id and text hash; a leaf's budget is spent on whole epochs and then
    on the next epoch's shortest prefix that reaches it, so a leaf exceeds its
    budget by less than one document.  Documents without words are never
    needed to reach a budget: they come first in their epoch and cost nothing.
    A leaf whose documents all have no words has no budget, and none of its
    documents is taken in any epoch, as in the SQL.
    Null languages and sources are values like others; rows repeated in full
    are one document with n_rows > 1, whose tokens count n_rows times.  An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    each = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"), domain_of(F.col(source_col)).alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.md5(text_or_empty(text_col).cast("binary")).alias("text_md5"), token_count(text_col).alias("words"),
    )
    each = scratch.write(each.groupBy("id", "key", "domain", "lang", "source", "text_md5", "words").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_tokens", F.col("words") * F.col("n_rows")).drop("words"))
    leaves = scratch.write(each.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    plan = scratch.write(budgets(leaves.drop("n_docs"), total, fraction, max_epochs, weights))
    # As many buckets in a leaf as documents in a bucket, about, so that neither is more than the root of the largest leaf.
    digits = max(1, math.ceil(math.log((leaves.agg(F.max("n_docs")).first()[0] or 1) ** 0.5, 16)))
    return _taken(each, plan, max_epochs, seed, digits, scratch)


def _same_leaf(a: DataFrame, b: DataFrame, *more: str) -> Column:
    on = F.lit(True)
    for c in (*LEAF, *more):
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return on


def _taken(each: DataFrame, plan: DataFrame, max_epochs: int, seed: int, digits: int, scratch: Scratch) -> DataFrame:
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in LEAF], "tokens", "budget").filter("budget > 0")
    epochs = each.join(plan, _same_leaf(each, plan)).select(each["*"], "tokens", "budget", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    # What is left of the budget when the epoch begins; nothing is taken of later epochs.
    epochs = epochs.withColumn("left", F.col("budget") - F.col("epoch") * F.col("tokens")).filter("left > 0")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_md5")).cast("binary"))
    epochs = epochs.withColumn("place", F.when(F.col("n_tokens") == 0, F.lit("")).otherwise(place)).withColumn("bucket", F.substring("place", 1, digits))
    # An epoch that the budget covers is taken whole; in the last one, only the bucket where the budget ends is put in order.
    sums = scratch.write(epochs.filter("left < tokens").groupBy(*LEAF, "epoch", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens")))
    w = Window.partitionBy(*LEAF, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(w), F.lit(0))).select(*[F.col(c).alias(f"_{c}") for c in [*LEAF, "epoch", "bucket"]], "before", "bucket_tokens")
    whole = epochs.filter("left >= tokens")
    part = epochs.filter("left < tokens").join(starts, _same_leaf(epochs, starts, "epoch", "bucket")).filter("before < left")
    inside = part.filter("before + bucket_tokens <= left")
    cut = part.filter("before + bucket_tokens > left")
    order = Window.partitionBy(*LEAF, "epoch", "bucket").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("reached", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).filter("reached < left")
    columns = ["id", "key", *LEAF, "n_tokens", "epoch", "n_rows"]
    return whole.select(*columns).unionByName(inside.select(*columns)).unionByName(cut.select(*columns))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that mix takes, with docs' columns, once for each epoch that takes them."""
    taken = Scratch(docs.sparkSession, "mixing-taken").write(mix(docs, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("taken_id"), F.col("key").alias("taken_key")))
    keyed = whole_rows(docs, F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"))
    return keyed.join(taken, F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("key") == F.col("taken_key"))).select("doc.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), *LEAF, "n_tokens", "epoch")


def _share_sql(parent: str, order: str) -> str:
    """SQL of _share, over a table n with capacity, weight and parent_budget."""
    by = f"PARTITION BY {parent} ORDER BY capacity / weight, {order}"
    return f"""SELECT *, CASE WHEN is_full THEN capacity ELSE weight * first(CASE WHEN NOT is_full THEN rate END IGNORE NULLS)
        OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS budget
      FROM (SELECT *, capacity <= weight * rate AS is_full FROM (SELECT *, (parent_budget - coalesce(sum(capacity)
        OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM n))"""


_SQL = rf"""
WITH each AS (
  SELECT doc_id, lang, source, CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_extract(source, '([0-9])$', 1) BETWEEN '0' AND '4' THEN 'web'
      WHEN regexp_extract(source, '([0-9])$', 1) BETWEEN '5' AND '7' THEN 'books' ELSE 'reference' END AS domain,
    md5(coalesce(text, '')) AS text_md5, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE * 2 AS capacity FROM each GROUP BY ALL),
domains AS (WITH n AS (SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'web' THEN 5.0 WHEN 'books' THEN 3.0 WHEN 'reference' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    (SELECT sum(tokens) * 0.5 FROM leaves) AS parent_budget, 1 AS root FROM leaves GROUP BY domain) {_share_sql("root", "domain")}),
langs AS (WITH n AS (SELECT l.domain, l.lang, sum(l.capacity) AS capacity, CASE l.lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    any_value(d.budget) AS parent_budget FROM leaves l JOIN domains d ON l.domain IS NOT DISTINCT FROM d.domain GROUP BY l.domain, l.lang) {_share_sql("domain", "lang")}),
plan AS (WITH n AS (SELECT l.*, 1.0::DOUBLE AS weight, g.budget AS parent_budget FROM leaves l JOIN langs g ON l.domain IS NOT DISTINCT FROM g.domain AND l.lang IS NOT DISTINCT FROM g.lang)
    {_share_sql("domain, lang", "source")}),
placed AS (
  SELECT e.*, epoch, p.budget - epoch * p.tokens AS rest, CASE WHEN n_tokens = 0 THEN '' ELSE md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || text_md5) END AS place
  FROM each e JOIN plan p ON e.domain IS NOT DISTINCT FROM p.domain AND e.lang IS NOT DISTINCT FROM p.lang AND e.source IS NOT DISTINCT FROM p.source, (SELECT unnest([0, 1]) AS epoch))
SELECT doc_id, domain, lang, source, n_tokens, epoch::INTEGER AS epoch FROM (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM placed WHERE rest > 0) WHERE reached < rest"""

QUERIES = {"op4_mix": op4_mix}
ORACLE_SQL = {"op4_mix": _SQL}
