"""Near-duplicate documents: a Jaccard self-join of word-shingle sets with adaptive multi-match prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table, whole_rows
from .components import components
from .sketch import MAX_CELLS, PART_SCHEMA, Counter, DenseCounter, LogSketch, TwiceSketch, cells_for, count_hashes, log_cells_for, others, text_bytes
from .words import mix, slices, split_words, valid_starts, window_hashes, word_hashes

#: Words in a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Most shared prefix tokens that a document asks for.
MOST_MATCHES = 4
#: Cost of verifying one candidate, in postings.
VERIFY_COST = 4.0
#: Sizes of sets within this ratio form a band.
BAND = 1.04
#: Postings of a token in one task, about; a more frequent one is dealt to several.
HOT = 1000
#: UTF-8 bytes for each word, about.
BYTES_PER_WORD = 6


_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


@dataclass(frozen=True)
class _Naming:
    """Sets are named by a sum of their tokens' hashes; those of a name that different sets share, by two such sums."""

    shared: np.ndarray
    bits: int


class _Sets:
    """Shingle sets of the rows of one slice: distinct hashes in flat, sorted within each row."""

    def __init__(self, texts: pa.Array, shingle: int):
        words, counts = split_words(texts, lower=True)
        h = word_hashes(words)
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(valid_starts(counts, shingle)) if len(h) else np.zeros(0, np.int64)
        tokens, owners = [window_hashes(h, shingle)[at] if len(at) else np.zeros(0, np.uint64)], [row[at]]
        firsts = np.cumsum(counts) - counts
        for n in range(1, shingle):  # a shorter text is one shingle
            short = np.flatnonzero(counts == n)
            if len(short):
                tokens.append(mix(window_hashes(h, n)[firsts[short]] + np.uint64(n)))
                owners.append(short)
        # Long texts are already together; a short one has a single shingle.
        some, sizes = np.unique(owners[0], return_counts=True)
        rows = dict(zip(some.tolist(), map(np.unique, np.split(tokens[0], np.cumsum(sizes)[:-1])), strict=True)) if len(some) else {}
        rows |= {int(r): t for one, owner in zip(tokens[1:], owners[1:], strict=True) for r, t in zip(owner, one.reshape(-1, 1), strict=True)}
        each = [rows[r] for r in sorted(rows)]
        self.n = np.zeros(len(counts), np.int64)
        self.n[sorted(rows)] = [len(t) for t in each]
        self.flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(counts)), self.n)

    def names(self, bits: int) -> np.ndarray:
        """Two independent names of each row's set, of ``bits`` and of 64 bits: equal sets have equal ones."""
        out = np.zeros((2, len(self.n)), np.uint64)
        if len(self.flat):
            some = np.flatnonzero(self.n)
            for k, salt in enumerate(_SALTS):
                out[k, some] = np.add.reduceat(mix(self.flat ^ salt), (np.cumsum(self.n) - self.n)[some])
        out = mix(out + self.n.astype(np.uint64))
        out[0] >>= np.uint64(64 - bits)
        return out

    def keys(self, naming: _Naming) -> np.ndarray:
        """A 64-bit name of each row's set, different for different sets."""
        first, second = self.names(naming.bits)
        return np.where(np.isin(first.view(np.int64), naming.shared), mix(first ^ second), first)

    def others(self, logs: LogSketch) -> np.ndarray:
        """About how many other texts hold each token of flat."""
        return others(logs.level(self.flat))

    def prefixes(self, logs: LogSketch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens of flat are in their row's prefix, each token's place in its row's order from 1, and how many prefix tokens each row asks a partner to share.

        Tokens are ordered by corpus frequency, then hash.  A partner shares at
        least a = ceil(percent * n / 100) tokens, so the first n - a + m tokens
        of both share at least m.  m is what costs least: prefix tokens to
        emit, other documents in their postings, and candidates to verify, of
        which at most one in m postings can match m times.
        """
        level = logs.level(self.flat)
        # flat is sorted, so a stable sort by level and leading bits is one by level and hash, the same for every row.
        key = level.astype(np.uint64) << np.uint64(56) | self.flat >> np.uint64(8)
        firsts = (np.cumsum(self.n) - self.n).tolist()
        order = np.concatenate([a + np.argsort(key[a : a + n], kind="stable") for a, n in zip(firsts, self.n.tolist(), strict=True)]) if len(key) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(others(level[order]))])
        first = np.cumsum(self.n) - self.n
        need = -(-percent * self.n // 100)
        best, matches, length = np.full(len(self.n), np.inf), np.ones(len(self.n), np.int64), np.zeros(len(self.n), np.int64)
        for m in range(1, MOST_MATCHES + 1):
            size = self.n - need + m
            fits = need >= m
            met = sums[np.where(fits, first + size, first)] - sums[first]
            cost = np.where(fits, size + met * (1 + VERIFY_COST / m), np.inf)
            better = cost < best
            best[better], matches[better], length[better] = cost[better], m, size[better]
        place = np.zeros(len(self.flat), np.int64)
        place[order] = np.arange(len(self.flat)) - first[self.row[order]] + 1
        return place <= length[self.row], place, matches


def _each(batches: Iterator[pa.RecordBatch], shingle: int, wanted: TwiceSketch | None = None) -> Iterator[tuple[pa.RecordBatch, _Sets]]:
    for batch in batches:
        if wanted:
            batch = batch.filter(pa.array(wanted.at_least(batch.column("h").to_numpy().view(np.uint64), 1)))
        for rows in slices(batch, "text"):
            yield rows, _Sets(rows.column("text"), shingle)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets_and_counts(rows: DataFrame, cells: int, shingle: int, bits: int) -> DataFrame:
    """(id, n, key, second, apart) of each row, with both names of its set and their mix; and, where segment is not null, parts of the sketch of token counts."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, names = DenseCounter(cells), ["id", "n", "key", "second", "apart", "segment", "cells", "counts"]
        types = {"segment": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}

        def counts() -> pa.RecordBatch:
            part = counter.flush()
            return pa.RecordBatch.from_arrays([pa.nulls(len(part), id_type[0]), *(pa.nulls(len(part), pa.int64()),) * 4, *part.columns], names)

        id_type: list[pa.DataType] = []
        for part, s in _each(batches, shingle):
            id_type[:] = [part.column("id").type]
            key, second = s.names(bits)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s.n), *map(_signed, (key, second, mix(key ^ second))), *(pa.nulls(len(part), t) for t in types.values())], names)
            counter.add(s.flat)
        if id_type:
            yield counts()

    return rows.mapInArrow(run, f"id {kind.simpleString()}, n long, key long, second long, apart long, segment int, cells binary, counts binary")


def _postings(rows: DataFrame, logs: LogSketch, load: float, twice: TwiceSketch | None, firsts: TwiceSketch | None, naming: _Naming, shingle: int, percent: int) -> DataFrame:
    """(token, deal, key, n, matches, share, at): the prefix tokens that may occur in another prefix, and their places in the order of the set.

    deal spreads the postings of a token that the sketch takes for hot, and is 0
    for others; share is the part of the set that is here.
    """
    most = max(HOT, 4 * math.sqrt(load))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in _each(batches, shingle, firsts):
            inside, place, matches = s.prefixes(logs, percent)
            at = np.flatnonzero(inside)
            at = at[twice.often(s.flat[at])] if twice else at
            row, deals = s.row[at], (s.others(logs)[at] // most).astype(np.int64)
            key, share = s.keys(naming)[row], np.bincount(row, minlength=len(s.n)) / np.maximum(s.n, 1)
            yield pa.RecordBatch.from_arrays(
                [_signed(s.flat[at]), pa.array(np.where(deals > 0, 1 + (mix(key) >> np.uint64(1)).astype(np.int64) % (deals + 1), 0).astype(np.int32)), _signed(key), pa.array(s.n[row].astype(np.int32)), pa.array(matches[row].astype(np.int32)), pa.array(share[row].astype(np.float32)), pa.array(place[at].astype(np.int32))],
                ["token", "deal", "key", "n", "matches", "share", "at"],
            )

    return rows.mapInArrow(run, "token long, deal int, key long, n int, matches int, share float, at int")


def _shared(posts: DataFrame) -> DataFrame:
    """(token, deal, key, n, matches, at, hub), each once, of the tokens that several keys hold, from one shuffle.

    Copies leave one posting.  Of a hot token, whose postings are dealt to
    several tasks, all stay.  The hub of a token (here still of one of its
    deals, if it is hot) is the key with the largest share, a document that
    many others derive from as a rule.
    """
    dealt = posts.repartition("token", "deal").dropDuplicates(["token", "deal", "key"])
    here = Window.partitionBy("token", "deal")
    hub = F.max(F.struct("share", "key", "n", "matches")).over(here)
    counted = dealt.select("*", F.count(F.lit(1)).over(here).alias("n_keys"), hub.alias("hub"))
    return counted.filter("n_keys > 1 or deal > 0").select("token", "deal", "key", "n", "matches", "at", "hub")


def _members(rows: DataFrame, wanted: TwiceSketch | None, naming: _Naming, shingle: int) -> DataFrame:
    """(key, tokens) of the rows (h, text) whose h may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in _each(batches, shingle, wanted):
            some = np.flatnonzero(s.n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s.n[some])]), pa.int32()), _signed(s.flat))
            yield pa.RecordBatch.from_arrays([_signed(s.keys(naming)[some]), lists], ["key", "tokens"])

    return rows.mapInArrow(run, "key long, tokens array<long>")


def _present(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(cells, 2)
    for batch in batches:
        counter.add(batch.column("h").to_numpy().view(np.uint64))
    yield counter.flush()


def _chosen(rows: DataFrame, max_cells: int) -> TwiceSketch | None:
    """A sketch of rows (h), which lets few others through; None if max_cells are too few for it."""
    cells = cells_for(rows.count(), max_cells)
    return cells and TwiceSketch(rows.mapInArrow(lambda batches: _present(batches, cells), PART_SCHEMA), cells)


def _verified(pairs: DataFrame, rows: DataFrame, each: DataFrame, naming: _Naming, shingle: int, percent: int, max_cells: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Sets are made again from the texts, of one document for each key that
    pairs hold: those that a sketch of the documents lets through, or, where
    max_cells are too few for it, that a join finds.
    """
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    chosen = scratch.write(each.groupBy("key").agg(F.min(F.xxhash64("id")).alias("h")).join(keys, "key").select("h"))
    texts, wanted = rows.select(F.xxhash64("id").alias("h"), "text"), _chosen(chosen, max_cells)
    if not wanted:
        texts = texts.join(chosen, "h", "left_semi")
    sets = scratch.write(_members(texts, wanted, naming, shingle))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    # A pair may come twice; a distinct here would keep Spark from splitting the pairs of one key.
    out = scratch.write(both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    scratch.drop(sets)
    return out


def _enough(shared: str, a: str, b: str, am: str, bm: str, percent: int) -> Column:
    """Whether sets of sizes a and b can be similar if their prefixes have ``shared`` tokens in common.

    They must share ``least`` in all.  Whichever prefix ends first in the
    order of tokens, what is shared up to its end is in both prefixes, and
    past it that set has only need - m tokens left.
    """
    least = F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / (100 + percent))
    left = lambda n, m: F.ceil(F.lit(percent) * F.col(n) / 100) - F.col(m)
    return F.col(shared) >= F.greatest(F.least(am, bm), least - F.greatest(left(a, am), left(b, bm)))


def _same_size(a: str, b: str, percent: int):
    """Sizes that allow the similarity."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) if percent else F.lit(True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, name_bits: int = 64, max_cells: int = MAX_CELLS) -> DataFrame:
    """(id, key, n_shingles, component_id), one row for each row of docs.

    A-Z count as a-z; a document's set holds its distinct shingles of
    ``shingle`` words, a shorter text being one shingle.  Documents link when
    100 * shared >= percent * united; component_id is the smallest id that
    links reach.  Texts without words link with nothing.  Rows repeated in
    full are linked copies; a null id never names a component unless all its
    ids are null.  An empty table gives no rows.

    Equal sets are one class from the start (key).  Postings hold prefix
    tokens only, less those that the merged sketch shows to be in one prefix
    (none less where max_cells are too few for the corpus).
    Classes are first compared with a central partner each; then every pair of
    classes of different components so far is compared that shares enough
    prefix tokens for its sizes.  A pair inside a component is never looked at
    again, so a group of near copies costs its size, not its square.  Shingles
    are told apart by 64-bit hashes, sets by one of ``name_bits``, or by two
    where different sets share one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngram-join")
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts, words = rows.select(F.xxhash64("id").alias("h"), "text"), text_bytes(docs, text_col) / BYTES_PER_WORD
    log_cells = log_cells_for(words)
    load = words / log_cells
    first = scratch.write(_sets_and_counts(rows, log_cells, shingle, name_bits))
    logs = LogSketch(first.filter("segment is not null").select("segment", "cells", "counts"), log_cells, load)
    each = first.filter("key is not null").select("id", "n", "key", "second", "apart")
    # Of n sets about n * n / 2^65 share a name: some hundreds of a hundred thousand million.
    shared_names = each.groupBy("key").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b").select("key")
    naming = _Naming(np.array(sorted(r["key"] for r in shared_names.collect()), np.int64), name_bits)
    clash = F.broadcast(spark.createDataFrame([(int(k), True) for k in naming.shared], "key long, clash boolean"))
    each = scratch.write(each.join(clash, "key", "left").select("id", "n", F.when(F.col("clash"), F.col("apart")).otherwise(F.col("key")).alias("key")))
    scratch.drop(first)

    # From here on one text of each set will do, and the few more that a sketch lets through.
    firsts = _chosen(scratch.write(each.filter("n > 0").groupBy("key").agg(F.min(F.xxhash64("id")).alias("h")).select("h")), max_cells)
    cells = cells_for(words / 4, max_cells)
    # Without a sketch all prefix tokens are shuffled, and grouped exactly as are those that a sketch lets through.
    twice = cells and TwiceSketch(count_hashes(texts, lambda batch: (s.flat[s.prefixes(logs, percent)[0]] for _, s in _each(iter([batch]), shingle, firsts)), cells, 2), cells)
    live = scratch.write(_shared(_postings(texts, logs, load, twice, firsts, naming, shingle, percent)))

    # Keys whose component is still in doubt keep their own name; the smallest key names a component.
    tested = scratch.write(_central_pairs(live, percent))
    links = _verified(tested, rows, each, naming, shingle, percent, max_cells, scratch)
    named = scratch.write(components(links, scratch))
    pairs = scratch.write(_open_pairs(_labelled(live, named), percent, scratch).join(tested, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(pairs, rows, each, naming, shingle, percent, max_cells, scratch))
    named = scratch.write(components(links, scratch))

    classes = each.filter("n > 0").groupBy("key").agg(F.min("id").alias("smallest"))
    classes = classes.join(named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # Both are written, so that Spark can split a large component or class in the join.
    smallest = scratch.write(classes.groupBy("component").agg(F.min("smallest").alias("component_id")))
    names = scratch.write(classes.join(smallest, "component").select("key", "component_id"))
    linked = each.filter("n > 0").join(names, "key").select("id", "key", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(each.filter("n = 0").select("id", "key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def _labelled(live: DataFrame, named: DataFrame) -> DataFrame:
    """Postings with the component of their key, and how many keys it has."""
    sized = named.join(named.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("members")), "component").withColumnRenamed("node", "key")
    return live.drop("hub").join(sized, "key", "left").withColumn("component", F.coalesce("component", "key")).withColumn("members", F.coalesce("members", F.lit(1)))


def _whole_tokens(live: DataFrame, **ends) -> DataFrame:
    """live, where of the hot tokens each column of ``ends`` is reduced to one value over all deals.

    A hot token has HOT postings or more, so that these tokens are few beside
    the postings; the join is dealt by Spark, which splits hot ones.
    """
    hot = live.filter("deal > 0")
    whole = hot.groupBy("token").agg(*[f(name).alias(name) for name, f in ends.items()])
    return live.filter("deal = 0").unionByName(hot.drop(*ends).join(whole, "token").select(*live.columns))


def _central_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each key the hub of most of its tokens, if these alone are enough."""
    met = _whole_tokens(live, hub=F.max).filter((F.col("key") != F.col("hub.key")) & _same_size("n", "hub.n", percent))
    votes = met.groupBy("key", F.col("hub.key").alias("other")).agg(F.count(F.lit(1)).alias("votes"), *[F.first(F.col(c)).alias(name) for name, c in (("n", "n"), ("m", "matches"), ("hn", "hub.n"), ("hm", "hub.matches"))])
    best = votes.filter(_enough("votes", "n", "hn", "m", "hm", percent)).groupBy("key").agg(F.max(F.struct("votes", "other")).alias("best"))
    return best.select(F.least("key", "best.other").alias("a"), F.greatest("key", "best.other").alias("b")).distinct()


def _several(live: DataFrame, scratch: Scratch) -> DataFrame:
    """live with ``last``, the token's last component in the order of all components, of the tokens that several components share."""
    here, order = Window.partitionBy("token", "deal"), F.struct("members", "component")
    ends = scratch.write(live.select("*", F.min(order).over(here).alias("first"), F.max(order).over(here).alias("last")).filter("first <> last or deal > 0"))
    open_ = _whole_tokens(ends, first=F.min, last=F.max).filter("first <> last")
    return open_.select("token", "key", "n", "matches", "at", "members", "component", F.col("last.component").alias("last"))


def _open_pairs(live: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of different components that share enough prefix tokens.

    Components are in one order for all tokens, by how many keys they have and
    then by name, and a key looks for partners in later ones only.  So one side
    of a pair probes all tokens that the two share, and none is its token's
    last component.  That key must share ``asked`` of the tokens that lead it
    to partners of a band of sizes, so the first that it shares is not among
    the last asked - 1 of them, which are not probed; and after it either set
    must have room for what the two must share in all.
    """
    band = F.floor(F.ln("n") / F.ln(F.lit(BAND))).cast("int")
    open_ = scratch.write(_several(live, scratch).withColumn("band", band))
    bands = open_.groupBy("token", "band").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.collect_list(F.struct("band", "size")).alias("bands"))
    reach = math.ceil(math.log(100 / percent) / math.log(BAND)) + 1
    near = F.filter("bands", lambda b: (F.abs(b["band"] - F.col("band")) <= reach) & (b["size"] > F.when(b["band"] == F.col("band"), 1).otherwise(0)))
    way = F.struct("at", "token", F.transform(near, lambda b: b["band"]).alias("bands")).alias("way")
    ways = open_.filter("component <> last").join(bands, "token").select("key", "n", "matches", "members", "component", way).filter(F.size("way.bands") > 0)
    # A key has as many ways as prefix tokens at most.
    ways = ways.groupBy("key", "n", "matches", "members", "component").agg(F.array_sort(F.collect_list("way")).alias("ways"))
    ways = ways.select("*", F.explode(F.array_distinct(F.flatten(F.transform("ways", lambda w: w["bands"])))).alias("band"))
    low, high = F.floor(F.pow(F.lit(BAND), "band")), F.ceil(F.pow(F.lit(BAND), F.col("band") + 1))
    share = lambda n: F.ceil(F.lit(percent) * n / 100)
    asked = F.greatest(F.lit(1), F.ceil(F.lit(percent) * (F.col("n") + low) / (100 + percent)) - F.greatest(share(F.col("n")) - F.col("matches"), share(high) - 1)).cast("int")
    own = F.filter("ways", lambda w: F.array_contains(w["bands"], F.col("band")))
    ways = ways.select("key", "n", "matches", "members", "component", "band", own.alias("own"), asked.alias("asked")).filter(F.size("own") >= F.col("asked"))
    probe = F.explode(F.transform(F.slice("own", F.lit(1), F.size("own") - F.col("asked") + 1), lambda w: F.struct(w["at"].alias("i"), w["token"].alias("token")))).alias("p")
    probes = ways.select("band", F.col("key").alias("a"), F.col("n").alias("an"), F.col("matches").alias("am"), F.struct("members", "component").alias("ac"), probe).select("p.token", "band", "a", "an", "am", "p.i", "ac")
    right = open_.select("token", "band", F.col("key").alias("b"), F.col("n").alias("bn"), F.col("matches").alias("bm"), F.col("at").alias("j"), F.struct("members", "component").alias("bc"))
    room = 1 + F.least(F.col("an") - F.col("i"), F.col("bn") - F.col("j")) >= F.ceil(F.lit(percent) * (F.col("an") + F.col("bn")) / (100 + percent))
    met = probes.join(right, ["token", "band"]).filter((F.col("ac") < F.col("bc")) & room & _same_size("an", "bn", percent))
    pairs = met.select("a", "b", "an", "bn", "am", "bm").distinct()
    # Written, so that Spark can split the pairs of one key in the joins.
    prefixes = scratch.write(live.select("key", "token").groupBy("key").agg(F.collect_list("token").alias("prefix")))
    both = pairs.join(prefixes.select(F.col("key").alias("a"), F.col("prefix").alias("x")), "a").join(prefixes.select(F.col("key").alias("b"), F.col("prefix").alias("y")), "b")
    counted = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    return counted.filter(_enough("shared", "an", "bn", "am", "bm", percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id (nulls last), with docs' columns; of rows repeated in full one."""
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    named = whole_rows(docs, row.alias("row"), F.col(text_col).alias("text"))
    decided = Scratch(docs.sparkSession, "ngram-kept").write(near_duplicates(named, "row", "text"))
    dropped = decided.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("dropped"))
    kept = named.drop("text").join(dropped, F.col("row") == F.col("dropped"), "left_anti")
    if not decided.groupBy("id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["row"])
    return kept.select("doc.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL = {
    "op3_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM d, (SELECT unnest(generate_series(1, (SELECT greatest(max(len(w)), 5) FROM d))) AS p) g
  WHERE len(w) > 0 AND (p = 1 OR p <= len(w) - 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node)
SELECT node AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node""",
}
