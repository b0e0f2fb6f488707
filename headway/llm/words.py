"""Words and word-window hashes of whole Arrow batches, in numpy.

Runs inside ``mapInArrow`` tasks.  A word is a maximal run of characters other
than space and U+0009..U+000D; those are single bytes in UTF-8, so splitting
and hashing work on the UTF-8 bytes of a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most UTF-8 bytes handled at once; a longer single text is handled alone.
SLICE_BYTES = 2_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANES = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)),
    (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)),
)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row slices of about ``limit`` bytes of text, so that what a task holds does not depend on Arrow's batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        # A copy: some string kernels misread arrays that begin inside a buffer.
        yield batch.take(pa.array(np.arange(start, stop)))
        start = stop


def split_words(column: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all rows in order, and how many each row has (null: none)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(lists)) if len(flat) else np.zeros(len(lists), int)
    return flat.filter(full), counts.astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8 bytes: eight bytes at a time, mixed into what came before."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.zeros(int(bounds[-1]) + 8, np.uint8)
    raw[:-8] = np.frombuffer(data, np.uint8, int(bounds[-1]))
    eights = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    starts, sizes = bounds[:-1], np.diff(bounds)
    h, left = mix(sizes.astype(np.uint64) * _M1), np.arange(len(words))
    for done in range(0, int(sizes.max()), 8):
        left = left[sizes[left] > done]
        part = eights[starts[left] + done].reshape(-1).view("<u8")
        rest = np.minimum(sizes[left] - done, 8).astype(np.uint64)
        part = part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        h[left] = mix(h[left] * _M2 ^ part)
    return h


def window_hashes(h: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` successive elements of h, built by doubling.  Result i covers h[i : i + size]."""
    a, b = _LANES[lane]
    if len(h) < size:
        return np.zeros(0, np.uint64)
    total, have, power, width = None, 0, mix(h + a), 1
    while True:
        if size & width:
            if total is None:
                total, have = power, width
            else:
                n = len(h) - have - width + 1
                total, have = mix(total[:n] * a + power[have : have + n] * b + np.uint64(have)), have + width
        if 2 * width > size:
            return total[: len(h) - size + 1]
        n = len(power) - width
        power = mix(power[:n] * b + power[width : width + n] * a + np.uint64(width))
        width *= 2


def valid_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Which starts among all words of a batch leave ``size`` words in the same row."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(total) + size <= ends
