"""Count sketches over the whole corpus: filled in each task and merged by ranges of cells.

A sketch of up to MAX_CELLS is broadcast, as long as that leaves it LEAST_PER_ITEM
cells for each item; beyond, where most hashes would pass by accident, the
callers ask the cluster instead, by a join or an exact grouping.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

#: Cells in a segment; a merging task holds one segment.
SEGMENT = 1 << 20
#: Columns by which tasks hand on their counts.
PART_SCHEMA = "segment int, cells binary, counts binary"
#: Counts that a task holds before it hands them on.
FLUSH = 2_000_000
#: Most cells of a sketch that is broadcast.  At two bits a cell these are 64 MB.
MAX_CELLS = 1 << 28
#: Cells for each item, if there is room, and at least: 5 and 40 in a hundred hashes of one occurrence pass as repeated.
PER_ITEM, LEAST_PER_ITEM = 8, 2


def cells_for(items: float, max_cells: int = MAX_CELLS) -> int | None:
    """Cells of a sketch of items, a power of two; None if max_cells would leave too few for each."""
    wanted = max(SEGMENT, 1 << math.ceil(math.log2(max(1.0, items * PER_ITEM))))
    return wanted if wanted <= max_cells else max_cells if max_cells >= items * LEAST_PER_ITEM and max_cells >= SEGMENT else None


def places(h: np.ndarray, cells: int, rows: int) -> np.ndarray:
    """The cell of each hash in each of ``rows`` equal parts of the sketch."""
    part = cells // rows
    return np.stack([(mix(h + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(part)).astype(np.int64) + r * part for r in range(rows)])


class Counter:
    """Counts in one task, handed on as sparse segments.  Counts above 255 stay 255: only "few" and "more" are told apart so far up."""

    def __init__(self, cells: int, rows: int):
        self.cells, self.rows, self.parts, self.held = cells, rows, [], 0

    def add(self, h: np.ndarray) -> None:
        if len(h):
            self.parts.append(places(h, self.cells, self.rows).ravel())
            self.held += self.parts[-1].size

    def flush(self) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        segments, n = at // SEGMENT, np.minimum(n, 255).astype(np.uint8)
        cuts = np.flatnonzero(np.diff(segments)) + 1
        coded = [_pack(a % SEGMENT, c) for a, c in zip(np.split(at, cuts), np.split(n, cuts), strict=True)] if len(at) else []
        first = segments[np.concatenate([[0], cuts])] if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array([a for a, _ in coded], pa.binary()), pa.array([c for _, c in coded], pa.binary())], ["segment", "cells", "counts"])


#: Cells in a segment of dense counts.
DENSE_SEGMENT = 1 << 14


#: Parts of a dense segment that one task adds up; more are added up in two steps.
PARTS = 1000


def log_cells_for(items: float) -> int:
    """Cells of a sketch of the frequencies of items: a 128th of them, from 2^20 to 2^24, so one byte for each is broadcast."""
    return 1 << min(24, max(20, math.ceil(math.log2(max(1.0, items / 128)))))


class DenseCounter:
    """All counts of one task, handed on once; counts above 255 stay 255."""

    def __init__(self, cells: int):
        self.counts, self.parts, self.held = np.zeros(cells, np.uint32), [], 0

    def add(self, h: np.ndarray) -> None:
        self.parts.append(places(h, len(self.counts), 1)[0])
        self.held += len(h)
        if self.held > FLUSH:
            self._sum()

    def _sum(self) -> None:
        for at in self.parts and [np.concatenate(self.parts)]:
            self.counts += np.bincount(at, minlength=len(self.counts)).astype(np.uint32)
        self.parts, self.held = [], 0

    def flush(self) -> pa.RecordBatch:
        self._sum()
        parts = np.minimum(self.counts, 255).astype(np.uint8).reshape(-1, DENSE_SEGMENT)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.nulls(len(parts), pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "cells", "counts"])


def _pack(at: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A segment's cells, byte by byte, which compresses well as they are sorted, and their counts."""
    return np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes(), counts.tobytes()


def _merge(rows: pd.DataFrame) -> np.ndarray:
    total = np.zeros(SEGMENT, np.uint32)
    for cells, counts in zip(rows["cells"], rows["counts"], strict=True):
        low, middle, high = np.frombuffer(cells, np.uint8).reshape(3, -1).astype(np.uint32)
        total[low | middle << 8 | high << 16] += np.frombuffer(counts, np.uint8)
    return total


def _twice(rows: pd.DataFrame) -> pd.DataFrame:
    c = np.minimum(_merge(rows), 2).astype(np.uint8).reshape(-1, 4)
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [(c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()]})


def _sums(rows: pd.DataFrame, kind: type) -> np.ndarray:
    total = np.zeros(DENSE_SEGMENT, np.uint64)
    for counts in rows["counts"]:
        total += np.frombuffer(counts, kind)
    return total


def _partly(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "counts": [_sums(rows, np.uint8).tobytes()]})


#: Levels of counts that chance may make, below those of logarithms.
LOW = 32


def _logs(rows: pd.DataFrame, load: float) -> pd.DataFrame:
    c, chance = _sums(rows, np.uint64).astype(np.float64), load + 2 * math.sqrt(load)
    low = np.minimum(c * (LOW / max(chance, 1)), LOW - 1)
    levels = np.where((c >= load + 1) & (c > chance), np.minimum(LOW + 8 * np.log2(np.maximum(c - load, 1)), 255), low)
    return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [levels.astype(np.uint8).tobytes()]})


def others(level: np.ndarray) -> np.ndarray:
    """About how many other texts hold a hash of some level."""
    return np.where(level >= LOW, np.exp2((level.astype(np.float64) - LOW) / 8) - 1, 0)


def _gathered(parts: DataFrame, merge, size: int, width: int) -> np.ndarray:
    """The merged sketch: ``size`` bytes, whatever the corpus."""
    out = np.zeros(size, np.uint8)
    for r in parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary").toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


class TwiceSketch:
    """Two bits a cell: none, one, more.  ``often`` never misses a hash that was counted twice."""

    def __init__(self, parts: DataFrame, cells: int, rows: int = 2):
        self.cells, self.rows = cells, rows
        self.bits: Broadcast = parts.sparkSession.sparkContext.broadcast(_gathered(parts, _twice, cells // 4, SEGMENT // 4))

    def at_least(self, h: np.ndarray, n: int) -> np.ndarray:
        bits, out = self.bits.value, np.ones(len(h), bool)
        for at in places(h, self.cells, self.rows):
            out &= (bits[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3) >= n
        return out

    def often(self, h: np.ndarray) -> np.ndarray:
        return self.at_least(h, 2)


class LogSketch:
    """A level for each hash that grows with its count, in one byte: the count's logarithm after what others in its cell count on average (load) is taken off, or, where the rest is no more than their spread, one of LOW levels in proportion."""

    def __init__(self, parts: DataFrame, cells: int, load: float):
        """parts is a written table.  Of each segment PARTS parts at most are added up in a task, then the sums."""
        self.cells = cells
        salts = max(1, math.ceil(parts.count() * DENSE_SEGMENT / cells / PARTS))
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt")
        parts = parts.select("segment", "counts", salt).groupBy("segment", "salt").applyInPandas(_partly, "segment int, counts binary")
        self.logs: Broadcast = parts.sparkSession.sparkContext.broadcast(_gathered(parts, lambda rows: _logs(rows, load), cells, DENSE_SEGMENT))

    def level(self, h: np.ndarray) -> np.ndarray:
        return self.logs.value[places(h, self.cells, 1)[0]]


def count_hashes(rows: DataFrame, hashes, cells: int, depth: int) -> DataFrame:
    """Sketch parts of ``hashes(batch)``, arrays of hashes for each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(cells, depth)
        for batch in batches:
            for h in hashes(batch):
                counter.add(h)
                if counter.held > FLUSH:
                    yield counter.flush()
        yield counter.flush()

    return rows.mapInArrow(run, PART_SCHEMA)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
