"""Arrow strings as numpy arrays, and hashes of their words without a loop over rows."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that belong to words: letters, digits and everything beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_powers: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = powers(base, max(n, 1 << 16))
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    n = len(texts)
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of lower-cased texts, in order, and where each row's words begin (rows + 1 entries)."""
    at, raw = buffers(pc.utf8_lower(texts))
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = WORD[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    # a row's first byte begins a word even if the row before ended in one
    first = at[1:-1]
    first = first[(first > 0) & (first < len(raw))]
    cut = first[inside[first] & inside[first - 1]] if len(first) else first
    marks = np.flatnonzero(edge)
    if len(cut):
        marks = np.sort(np.concatenate([marks, np.unique(cut), np.unique(cut)]))
    begin, end = marks[0::2], marks[1::2]
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(raw)), out=total[1:])
    words = (total[end] - total[begin]) * cached_powers(INVERSE, len(raw) + 1)[begin]
    return mix(words), np.searchsorted(begin, at)


#: Bytes that a task is given of what is shuffled by keys.
TASK_BYTES = 64 << 20


def by_keys(df: DataFrame, size: float, *keys: str) -> DataFrame:
    """``df``, of about ``size`` bytes, partitioned by ``keys``: in as many parts as the session says, which may then be
    joined where they are small, or in as many as bring a part below ``TASK_BYTES``."""
    least = math.ceil(size / TASK_BYTES)
    if least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(least, *keys)
    return df.repartition(*keys)


def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows. After the last one the worker, which lives on, gives back the memory it has freed."""
    try:
        yield from (b for b in parts if b.num_rows)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
