"""Substring deduplication: word windows that occur again anywhere are removed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .sketch import MAX_CELLS, TwiceSketch, cells_for, count_hashes, text_bytes
from .words import mix, slices, split_words, valid_starts, window_hashes, word_hashes

#: Words in a window, and in the run that stands for it in the sketch.
WINDOW, ANCHOR = 35, 8
#: UTF-8 bytes of text for each window run that the sketch counts, about.
BYTES_PER_ANCHOR = 75
#: Cells of a sketch that is a table of those that occur: enough for any corpus.
TABLE_CELLS = 1 << 56
_PLACE = np.uint64((1 << 28) - 1)


class _Windows:
    """Words, windows and anchors of the rows of one slice of a batch."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.words, self.counts = split_words(texts)
        self.h = word_hashes(self.words)
        self.starts = np.flatnonzero(valid_starts(self.counts, window)) if len(self.h) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """All runs of ANCHOR words, hashed, and the place of each window's anchor: its run with the smallest hash, the leftmost of equal ones."""
        size = min(ANCHOR, self.window)
        runs = window_hashes(self.h, size)
        if not len(self.starts):
            return runs, np.zeros(0, np.int64)
        low, span, width = (mix(runs) & ~_PLACE) | np.arange(len(runs), dtype=np.uint64), self.window - size + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return runs, (np.minimum(low[self.starts], low[self.starts + span - width]) & _PLACE).astype(np.int64)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors, each place once, and their places."""
        runs, at = self.anchors()
        at = at[np.concatenate([[True], np.diff(at) != 0])] if len(at) else at
        return runs[at], at

    def starts_of(self, often: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The starts of the windows whose anchor is often there."""
        runs, at = self.anchors()
        if not len(at):
            return self.starts
        new = np.concatenate([[True], np.diff(at) != 0])
        return self.starts[often(runs[at[new]])[np.cumsum(new) - 1]]


def _each(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, _Windows]]:
    for batch in batches:
        for rows in slices(batch, "text"):
            yield rows, _Windows(rows.column("text"), window)


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h) & np.uint64(TABLE_CELLS - 1)).view(np.int64)


#: From a slice, how to tell which hashes of anchors may be repeated.
Often = Callable[[pa.RecordBatch], Callable[[np.ndarray], np.ndarray]]


def _broadcast(rows: DataFrame, cells: int, window: int) -> tuple[DataFrame, Often]:
    """rows, and how to ask a sketch that every task holds."""
    sketch = TwiceSketch(count_hashes(rows.select("text"), lambda batch: (w.counted()[0] for _, w in _each(iter([batch]), window)), cells, 2), cells)
    return rows, lambda part: sketch.often


def _joined(rows: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, Often]:
    """rows joined with those of their cells that are counted twice, for a sketch of any size that is a table of its cells.

    Only cells and a hash of the row travel.  Rows that share that hash share
    their cells, which lets more windows through and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _each(batches, window):
            h, at = w.counted()
            row = np.searchsorted(np.cumsum(w.counts), at, "right")
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(row)), pa.array(_cells(h))], ["row", "cell"])

    def often(part: pa.RecordBatch) -> Callable[[np.ndarray], np.ndarray]:
        known = np.unique(pc.list_flatten(part.column("cells")).to_numpy(zero_copy_only=False).astype(np.int64))
        return lambda h: np.isin(_cells(h), known)

    rows = rows.withColumn("row", F.xxhash64("id", "key"))
    held = scratch.write(rows.select("row", "text").mapInArrow(run, "row long, cell long").groupBy("row", "cell").agg(F.count(F.lit(1)).alias("n")))
    twice = scratch.write(held.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell"))
    found = scratch.write(held.join(twice, "cell", "left_semi").groupBy("row").agg(F.collect_list("cell").alias("cells")))
    return rows.join(found, "row", "left").drop("row"), often


def _single(rows: DataFrame, often: Often, window: int) -> DataFrame:
    """(id, key, places): the windows that the sketch takes for repeated and that are not, exactly.

    Windows are grouped under two independent 64-bit hashes of their words;
    each task sums its own first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _each(batches, window):
            at = w.starts_of(often(part))
            if not len(at):
                continue
            a, b = (window_hashes(w.h, window, lane)[at] for lane in (0, 1))
            order = np.lexsort((at, b, a))
            a, b, at = a[order], b[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]))
            row = np.searchsorted(np.cumsum(w.counts), at[first], "right")
            place = at[first] - (np.cumsum(w.counts) - w.counts)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(np.diff(np.append(first, len(at)))), part.column("id").take(pa.array(row)), part.column("key").take(pa.array(row)), pa.array(place.astype(np.int32))],
                ["a", "b", "n", "id", "key", "place"],
            )

    found = rows.mapInArrow(run, f"a long, b long, n long, id {rows.schema['id'].dataType.simpleString()}, key long, place int")
    alone = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("id").alias("id"), F.first("key").alias("key"), F.first("place").alias("place")).filter("n = 1")
    return alone.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("place").alias("alone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_cells: int = MAX_CELLS) -> DataFrame:
    """(id, text, n_words, n_removed): each row's words that no repeated window covers, joined by one space.

    A window is ``window`` successive words of one text, and is repeated if its
    word sequence also starts at another place of any text, the same included;
    rows repeated in full repeat each other's windows.  The first pass counts
    every window under its anchor in a sketch merged from all tasks, which can
    only overestimate; the second groups exactly the windows that may be
    repeated and names those that are not; the third removes.  Null and empty
    texts have no words; shorter texts than a window lose none.  An empty
    table gives no rows; other columns are not read.

    Up to ``max_cells`` every task holds the sketch; where that is too few for
    the corpus, it is a table of its cells that rows are joined with.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    cells = cells_for(text_bytes(docs, text_col) / BYTES_PER_ANCHOR, max_cells)
    rows, often = _broadcast(rows, cells, window) if cells else _joined(rows, window, scratch)
    alone = _single(rows, often, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in _each(batches, window):
            total = len(w.h)
            repeated = np.zeros(total, bool)
            repeated[w.starts_of(often(part))] = True
            spared = part.column("alone")
            firsts = np.cumsum(w.counts) - w.counts
            lengths = pc.fill_null(pc.list_value_length(spared), 0).to_numpy(zero_copy_only=False)
            repeated[np.repeat(firsts, lengths) + pc.list_flatten(spared).to_numpy(zero_copy_only=False)] = False
            at = np.flatnonzero(repeated)
            change = np.zeros(total + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            keep = np.cumsum(change)[:total] == 0
            row = np.repeat(np.arange(len(w.counts)), w.counts)
            left = np.bincount(row[keep], minlength=len(w.counts))
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)])), w.words.filter(pa.array(keep)))
            text = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays([part.column("id"), text.cast(pa.string()), pa.array(w.counts), pa.array(w.counts - left)], ["id", "text", "n_words", "n_removed"])

    joined = rows.join(alone, rows.id.eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(*rows.columns, "alone").drop("key")
    return joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_words long, n_removed long")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE_SQL = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS win FROM d, (SELECT unnest(generate_series(1, (SELECT max(len(w)) FROM d) - {WINDOW - 1})) AS p) g WHERE p <= len(w) - {WINDOW - 1}),
r AS (SELECT doc_id, p FROM s JOIN (SELECT win FROM s GROUP BY win HAVING count(*) > 1) USING (win)),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM r, range({WINDOW}) g(k)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
