"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, text_or_empty, whole_rows

#: Characters in a block.  Most documents are one block; the names of longer ones are paired.
BLOCK = 4096


def normalised(text_col: str) -> Column:
    """The text with each white-space run as one space.  Only texts with successive spaces need a regular expression, which costs more than all else."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(chr(c)), F.lit(" ")), range(0x09, 0x0E), text_or_empty(text_col))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, SPACE, " ")).otherwise(spaced)


def _named(distinct: DataFrame, by: list[str], keep: list[str], scratch: Scratch) -> DataFrame:
    """Give each row of ``distinct`` an integer: its partition and its place in the partition's sort order.  Written, so a name never changes."""
    return scratch.write(distinct.sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("name")))


def _block_names(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, key, n_blocks, at, name) for blocks (id, key, n_blocks, at, content).

    Contents are made distinct in each task and then across tasks; names travel
    back under the content's 64-bit hash.  The contents of a hash that two
    contents share (found exactly, as a rule none) are named apart, below
    zero, and joined by content.
    """
    blocks = blocks.withColumn("h", F.xxhash64("content"))
    names = _named(blocks.select("h", "content").distinct(), ["content"], ["h"], scratch)
    shared = names.groupBy("h").count().filter("count > 1").select("h")
    out = ["id", "key", "n_blocks", "at", "name"]
    if shared.isEmpty():
        return blocks.drop("content").join(names, "h").select(*out)
    clash = blocks.join(shared, "h", "left_semi")
    apart = _named(clash.select("content").distinct(), ["content"], ["content"], scratch)
    return (
        blocks.drop("content").join(names.join(shared, "h", "left_anti"), "h").select(*out)
        .unionByName(clash.join(apart.withColumn("name", -1 - F.col("name")), "content").select(*out))
    )


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, key, n_rows, level, name): two texts are equal if and only if their level and name are.

    A text is normalised (null is the empty text, each white-space run one
    space) and cut into blocks of ``block`` characters; equal blocks get equal
    integers.  Each further round names adjacent pairs of integers, until a
    document has one left after ``level`` rounds.  ``key`` is the text's hash,
    which tells rows that share an id apart; rows repeated in full are one
    document with n_rows > 1.  A null id is a value like others.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact-dedup")
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    blocks = (
        docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
        .select("id", F.xxhash64("norm").alias("key"), F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut).alias("blocks"))
        .select("id", "key", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("at", "content"))
    )
    rows = scratch.write(_block_names(blocks, scratch).groupBy("id", "key", "n_blocks", "at", "name").agg(F.count(F.lit(1)).alias("n_rows")))
    rounds, done = ((rows.agg(F.max("n_blocks")).first()[0] or 1) - 1).bit_length(), []
    for level in range(rounds + 1):
        done.append(rows.filter("n_blocks = 1").select("id", "key", "n_rows", F.lit(level).alias("level"), "name"))
        if level == rounds:
            break
        # A last block without a partner is paired with null, which no other pair holds.
        pairs = rows.filter("n_blocks > 1").groupBy("id", "key", F.expr("(n_blocks + 1) div 2").alias("n_blocks"), F.expr("at div 2").alias("at")).agg(
            F.max("n_rows").alias("n_rows"), F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b")
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], scratch)
        rows = scratch.write(
            pairs.alias("p").join(names.alias("n"), (F.col("p.a") == F.col("n.a")) & F.col("p.b").eqNullSafe(F.col("n.b")))
            .select("id", "key", F.col("n_blocks").cast("int").alias("n_blocks"), "at", "name", "n_rows")
        )
    return reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, key, n_rows, keep_id, group_size, kept), one row for each document.

    Of equal texts the smallest id stays (nulls last); group_size counts rows,
    repeated ones too.  Empty and null texts form one group.  An empty table
    gives no rows.  Other columns of docs are not read.
    """
    each = identities(docs, id_col, text_col, block)
    # Written, so that Spark can split a large group in the join.
    groups = Scratch(docs.sparkSession, "exact-dedup-groups").write(each.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("n_rows").alias("group_size")))
    return each.join(groups, ["level", "name"]).select("id", "key", "n_rows", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns.  Of rows repeated in full one stays."""
    decided = Scratch(docs.sparkSession, "exact-dedup-kept").write(exact_duplicates(docs, id_col, text_col))
    drop = decided.filter(~F.col("kept")).select(F.col("id").alias("drop_id"), F.col("key").alias("drop_key"))
    keyed = whole_rows(docs, F.col(id_col).alias("id"), F.xxhash64(normalised(text_col)).alias("key"))
    kept = keyed.join(drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("key") == F.col("drop_key")), "left_anti")
    if not decided.filter("kept and n_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select("doc.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = normalised("text")
    own = docs.select("doc_id", F.xxhash64(text).alias("own_key"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    found = exact_duplicates(docs)
    return own.join(found, own.doc_id.eqNullSafe(found.id) & (own.own_key == found.key)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
}
