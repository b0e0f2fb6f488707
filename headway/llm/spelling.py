"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .words import mix, slices

#: Letters of a word, as a character class; only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
#: Shortest words, and fewest occurrences of one.
LENGTH, OCCURRENCES = 7, 2
#: How much more frequent than a word its form is, at least.
RATIO = 10
#: Of runs whose checksum 31 divides, the query deletes one letter, so that there are misspellings to find.
PLANTED = 31
#: Letters of the words in one automaton, and of the words that one task scans with it.
SHARD, CHUNK = 1 << 18, 1 << 20
#: Different words that a counting task holds before it hands them on.
HELD = 1_000_000
#: Letters compared at once.
COMPARED = 1 << 22

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, planted: int | None = None) -> DataFrame:
    """(word, n): the distinct words of at least ``length`` letters and how often they occur in all texts.

    A word is a maximal run of letters.  Null and empty texts have none, and an
    empty table gives no rows; rows repeated in full count each time.  With
    ``planted``, a run whose unsigned crc32 of "<id>:<run>" it divides loses
    the letter at crc32 % (letters of the run); rows without an id lose none.
    Each task counts first, and hands on its counts when it holds HELD words.
    """
    small_batches(docs.sparkSession)
    pattern = f"[{LETTERS}]{{{length},}}"  # a run is matched from its start and to its end, so it is maximal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = re.compile(pattern), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = runs.findall((text or "").translate(_LOWER))
                    if planted is None or doc is None:
                        counts.update(found)
                        continue
                    head = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), head)
                        if h % planted == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) >= length:
                            counts[word] += n
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def _codes(words: pd.Series, length: int) -> np.ndarray:
    """Code points of words of one length, a word in a row."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


def _keys(segments: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A number for each row's segment and code points, equal for equal ones."""
    h = mix(segments.astype(np.uint64) + np.uint64(1))
    for k in range(codes.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k].astype(np.uint64))
    return h


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of a becomes row i of b by replacing one code point, or inserting one if b's words are longer by one."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ahead = np.concatenate([a == b[:, :n], np.zeros((len(a), 1), bool)], axis=1).argmin(axis=1)
    behind = np.concatenate([(a == b[:, 1:])[:, ::-1], np.zeros((len(a), 1), bool)], axis=1).argmin(axis=1)
    return ahead + behind >= n


class Halves:
    """An automaton over both halves of words of one length.

    A half stands in it with a mark at the word's start or end, so that it is
    found only where a word may have it: one edit leaves one of the halves as it
    was, at the start or at the end.
    """

    def __init__(self, words: pd.Series):
        self.length = len(words.iloc[0])
        self.codes, self.cut = _codes(words, self.length), self.length // 2
        self.automaton, self.owner = ahocorasick.Automaton(), []
        for side, halves in enumerate((words.str[: self.cut], words.str[self.cut :])):
            number, distinct = pd.factorize(halves)
            self.owner.append(number)
            for k, half in enumerate(distinct):
                self.automaton.add_word(half + "\n" if side else "\n" + half, 2 * k + side)
        self.automaton.make_automaton()

    def _rests(self, side: int, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Beside the half that is the same, the other half's own two parts, in words that may be longer by one letter: one edit leaves one of these as it was, too."""
        more, n = codes.shape[1] - self.length, self.length
        low, high = (0, self.cut) if side else (self.cut, n)
        middle = (low + high) // 2
        yield codes[:, low:middle]
        yield codes[:, middle + more : high + more]

    def near(self, words: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j): the automaton's word i and words[j] are one edit apart.  words are of one length, the automaton's or one more.  No pair comes twice."""
        if not len(words):
            return
        codes = _codes(words, len(words.iloc[0]))
        found = np.fromiter((end << 32 | value for end, value in self.automaton.iter("\n" + "\n".join(words) + "\n")), np.int64)
        ends, value = found >> 32, found & 0xFFFFFFFF
        side, half = (value & 1).astype(bool), value >> 1
        # A mark stands before each word and after the last; the marks' distance gives the word.
        width = codes.shape[1] + 1
        word = np.where(side, ends // width - 1, (ends - self.cut) // width)
        pairs = [np.zeros(0, np.int64)]
        for s in (0, 1):
            segments, rows = half[side == s], word[side == s]
            for own, other in zip(self._rests(s, self.codes), self._rests(s, codes), strict=True):
                keys, asked = _keys(self.owner[s], own), _keys(segments, other[rows])
                order = np.argsort(keys, kind="stable")
                first, last = (np.searchsorted(keys[order], asked, where) for where in ("left", "right"))
                ends_at = np.cumsum(last - first)
                step = max(1, COMPARED // width)
                for start in range(0, int(ends_at[-1]) if len(ends_at) else 0, step):
                    at = np.arange(start, min(start + step, int(ends_at[-1])))
                    k = np.searchsorted(ends_at, at, "right")
                    i, j = order[last[k] - (ends_at[k] - at)], rows[k]
                    near = _one_edit(self.codes[i], codes[j])
                    pairs.append(np.unique(i[near].astype(np.int64) * len(codes) + j[near]))
        both = np.unique(np.concatenate(pairs))
        yield both // len(codes), both % len(codes)


def _near_words(shard: pd.DataFrame, scanned: pd.DataFrame) -> pd.DataFrame:
    """(word, near, best_n, best) of a shard's words and those scanned with it: how many are near, and the most frequent of these."""
    out = []
    if len(shard) and len(scanned):
        shard, halves = shard.reset_index(drop=True), Halves(shard["word"].reset_index(drop=True))
        for length in (halves.length, halves.length + 1):
            words = scanned[scanned["length"] == length].reset_index(drop=True)
            for i, j in halves.near(words["word"]):
                if length == halves.length:  # such a pair is found from either word: it counts where the automaton's is the smaller
                    smaller = shard["word"].to_numpy()[i] < words["word"].to_numpy()[j]
                    i, j = i[smaller], j[smaller]
                a, b = shard.iloc[i].reset_index(drop=True), words.iloc[j].reset_index(drop=True)
                for x, y in ((a, b), (b, a)):
                    out.append(pd.DataFrame({"word": x["word"], "best_n": y["n"], "best": y["word"]}))
    pairs = pd.concat(out) if out else pd.DataFrame({"word": [], "best_n": [], "best": []})
    pairs = pairs.sort_values(["word", "best_n", "best"], ascending=[True, False, True])
    first = pairs.drop_duplicates("word").set_index("word")
    first["near"] = pairs.groupby("word").size()
    return first.reset_index()[["word", "near", "best_n", "best"]].astype({"near": "int64", "best_n": "int64", "word": object, "best": object})


def near_words(words: DataFrame, scratch: Scratch, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, best_n, best) for those of words (word, n) that have near ones; of equally frequent ones best is the smallest.

    An automaton holds words of one length, ``shard`` letters of them; it scans
    the words of this length and of the next, ``chunk`` letters in a task.  So
    a task's memory is bounded, however many words there are, and the words
    of a length are sent out as often as it has automata.
    """
    words = scratch.write(words.withColumn("length", F.length("word")))
    sizes = words.groupBy("length").agg((F.count(F.lit(1)) * F.col("length")).alias("letters"))
    longer = sizes.select((F.col("length") - 1).alias("length"), F.col("letters").alias("more"))
    deal = scratch.write(sizes.join(longer, "length", "left").select(
        "length", F.ceil(F.col("letters") / shard).cast("int").alias("parts"), F.ceil((F.col("letters") + F.coalesce("more", F.lit(0))) / chunk).cast("int").alias("chunks"),
    ))
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = words.join(deal, "length").select(F.col("length").alias("home"), place("part", "parts").alias("part"), every("chunks").alias("chunk"), "word", "n")
    sent = words.withColumn("home", F.explode(F.array("length", F.col("length") - 1))).join(deal.withColumnRenamed("length", "home"), "home")
    sent = sent.select("home", every("parts").alias("part"), place("chunk", "chunks").alias("chunk"), *(F.col(c).alias(c) for c in ("word", "n", "length")))
    keys = ["home", "part", "chunk"]
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_near_words, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), "best"))  # of the most frequent the smallest
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select("word", "n_near", (-F.col("top.rank")).alias("best_n"), "top.best")


def spelling_variants(words: DataFrame, occurrences: int = OCCURRENCES, ratio: int = RATIO, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words (word, n), whose words are distinct, that occurs at least ``occurrences`` times.

    Near words differ by one inserted, deleted or replaced code point.  A
    word's form is its most frequent near word (ties: the smallest), if it is
    at least ``ratio`` times as frequent; root follows the forms to the last.
    Frequencies grow along forms, so chains end, after as many steps as the
    largest frequency has digits at most, and each round here doubles the
    steps taken.  Words that are null or of one letter are left out.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.write(words.filter((F.length("word") > 1) & (F.col("n") >= occurrences)).select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, scratch, shard, chunk)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = scratch.write(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"),
    ))
    roots = scratch.write(known.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = scratch.write(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if followed.filter("moved").isEmpty():
            break
        roots = followed.select("word", "root")
    return known.join(followed.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), planted=PLANTED))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE_SQL = {
    "op13_spelling_variants": r"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(range(9), lambda x, k: CASE WHEN k = 0 THEN x ELSE xor(x >> 1, 3988292384 * (x & 1)) END, b) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bs FROM counted),
summed AS (SELECT doc_id, run, c, xor(4294967295, list_reduce(bs, lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)]), 4294967295::BIGINT)) AS h FROM bytes, crcs),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY a),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN (SELECT min(b) FROM pairs p WHERE p.a = w.word AND p.n = top) END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN best ON best.a = w.word),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL""",
}
