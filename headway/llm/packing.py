"""Packing by concatenation and cutting: documents to fixed windows of tokens."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .words import slices, split_words

#: Tokens in a sequence.
LENGTH = 4096
#: The id that closes every document.
CLOSE = 2
#: Bytes of words and ids that a task remembers, about; beyond them it starts anew.
CACHE_BYTES = 24 << 20
#: Partition totals beyond this many are joined instead of broadcast.
BROADCAST_PARTITIONS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The rules of a tokenizer that drops white space, never joins across it, and takes letters and marks apart.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
#: A simple word is letters, composed and with one-to-one lower cases, and then marks.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,!?;:*#%&$|"
#: Byte-level spelling: bytes that are no printable Latin-1 character have one above U+00FF.
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places firsts[i] .. firsts[i] + sizes[i] - 1, one i after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - sizes), sizes)


def _bytes_of(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes, and where each string begins and the last ends."""
    _, offsets, data = strings.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]


class _TextEncoder:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's idle threads would spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and how many each text has, without closing ids."""
        ids = [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


class _WordEncoder(_TextEncoder):
    """Ids of whole texts through the ids of their words, for a tokenizer with _RULES.

    A text's ids are its words' ids in order, so each distinct word is encoded
    once.  A simple word's ids are those of its letters in lower case, which
    the vocabulary's model gives alone, and then those of its marks.  Letters,
    marks and words that are not simple are remembered as one Arrow array, with
    one array for all their ids.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self._forget()

    def _forget(self) -> None:
        """bounds: where each remembered string's ids begin in flat, and the last ones end."""
        self.known, self.bounds, self.flat = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> None:
        simple = pc.match_substring_regex(words, _LETTERS)
        letters, others = words.filter(simple), words.filter(pc.invert(simple))
        spelled = (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LEVEL) for w in letters.to_pylist())
        model = self.tokenizer.model
        ids = [np.fromiter((t.id for t in model.tokenize(w)), np.uint32) for w in spelled]
        rest = others.to_pylist()
        ids += [np.array(e.ids, np.uint32) for k in range(0, len(rest), 1024) for e in self.tokenizer.encode_batch_fast(rest[k : k + 1024], add_special_tokens=False)]
        self.known = pa.concat_arrays([self.known, letters, others])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.flat = np.concatenate([self.flat, *ids])

    def _place(self, strings: pa.Array) -> np.ndarray:
        """Where distinct strings are remembered, after learning the new ones."""
        at = pc.index_in(strings, self.known)
        if at.null_count:
            if self.known.nbytes + self.bounds.nbytes + self.flat.nbytes > CACHE_BYTES:
                self._forget()
                at = pa.nulls(len(strings), pa.int32())
            self._learn(strings.filter(at.is_null()))
            at = pc.index_in(strings, self.known)
        return at.to_numpy().astype(np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts = split_words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        bare = pc.utf8_rtrim(distinct, _MARKS)
        simple = pc.match_substring_regex(bare, _LETTERS)
        core = pc.if_else(simple, pc.utf8_lower(bare), distinct)
        data, bounds = _bytes_of(distinct)
        sizes = np.where(simple.to_numpy(zero_copy_only=False), np.diff(bounds) - pc.binary_length(bare).to_numpy(), 0)
        marks = data[_spread(bounds[1:] - sizes, sizes)]
        marks = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(marks)])
        parts = pa.concat_arrays([core, marks]).dictionary_encode()
        where = self._place(parts.dictionary)[parts.indices.to_numpy()]
        # Each distinct word's ids: its letters' and then its marks'.
        both = np.stack([where[: len(distinct)], where[len(distinct) :]], axis=1)
        lengths = np.diff(self.bounds)[both]
        flat = self.flat[_spread(self.bounds[both].ravel(), lengths.ravel())]
        sizes = lengths.sum(axis=1)
        firsts, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        each = sizes[which]
        ids = flat[_spread(firsts[which], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


def _encoder(path: str) -> _TextEncoder:
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    # Added tokens are looked for inside words; one that a simple word can hold, or that holds white space, is against the rules too.
    inside = all(set(t["content"]) - set(_MARKS) and not re.search(r"\s", t["content"]) and not re.match(_LETTERS, t["content"].rstrip(_MARKS)) for t in rules["added_tokens"])
    return _WordEncoder(path) if inside and all(rules.get(k) == v for k, v in _RULES.items()) else _TextEncoder(path)


def encode(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, close: int = CLOSE) -> DataFrame:
    """(id, ids, n_ids, part, before): a document's ids as little-endian unsigned 32-bit numbers, its partition, and the ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, sizes = encoder(rows.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(close)).astype("<u4")
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64).tobytes())
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), packed, pa.array(sizes), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + ends - sizes)],
                    ["id", "ids", "n_ids", "part", "before"],
                )
                before += int(ends[-1])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids binary, n_ids long, part int, before long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, close: int = CLOSE) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, filled, padded_to): one row for each piece of a document.

    All documents' ids, each closed by ``close``, form one stream, in the order
    of the encoded table's partitions; it is cut every ``length`` ids, and a
    document that crosses a cut gets a boundary record on either side.  The
    first pass over the written table sums each partition's ids and turns the
    sums into global offsets; the second cuts.  Only the last sequence can be
    short: ``filled`` ids, padded to ``length`` unless filled is a power of
    two.  Null and empty texts are the closing id alone; repeated rows and
    null ids are documents like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoded = Scratch(spark, "packing").write(encode(docs, id_col, text_col, tokenizer or default_tokenizer(), close))
    totals = [(r["part"], r["n"]) for r in encoded.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator()]
    total, bases = 0, []
    for part, n in totals:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")
    base = F.broadcast(base) if len(bases) <= BROADCAST_PARTITIONS else base
    cut = F.lit(length)
    placed = encoded.join(base, "part").withColumn("first", F.col("base") + F.col("before")).withColumn("last", F.col("first") + F.col("n_ids") - 1)
    pieces = placed.select("id", "ids", "n_ids", "first", "last", F.explode(F.sequence(F.expr(f"first div {length}"), F.expr(f"last div {length}"))).alias("sequence_id"))
    at, end = F.greatest("first", F.col("sequence_id") * cut), F.least(F.col("last") + 1, (F.col("sequence_id") + 1) * cut)
    filled = F.least(F.lit(length).cast("long"), F.lit(total).cast("long") - F.col("sequence_id") * cut)
    return (
        pieces.withColumn("start", at - F.col("first")).withColumn("length", end - at).withColumn("offset", at % cut).withColumn("filled", filled)
        .select(
            "id", "start", "length", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"), F.col("n_ids").alias("doc_tokens"),
            "sequence_id", "offset", "filled", F.when(F.bit_count("filled") == 1, F.col("filled")).otherwise(cut).cast("long").alias("padded_to"),
        )
    )


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "filled", "padded_to")


QUERIES = {"op9_pack": op9_pack}
ORACLE_SQL: dict[str, str] = {}
