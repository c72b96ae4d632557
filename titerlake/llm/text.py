"""Small Arrow helpers shared by the operators that work on batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that one slice of an Arrow batch holds at most (one longer text makes a slice of its own).
SLICE_BYTES = 2 << 20


def pick(*columns: tuple[str, str]) -> list[Column]:
    """``(source, alias)`` pairs as columns; quoting keeps names with dots or spaces whole."""
    return [F.col("`" + source.replace("`", "``") + "`").alias(alias) for source, alias in columns]


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column name starts with, for columns that an operator needs meanwhile."""
    out = "__"
    while any(c.startswith(out) for c in columns):
        out += "_"
    return out


def filled(array: pa.Array) -> pa.Array:
    """A string array as large_string, null as empty."""
    return pc.fill_null(array.cast(pa.large_string()), "")


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text starts (one offset more than texts)."""
    array = array.cast(pa.large_binary())
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most ``limit`` bytes of text, or one text."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive offsets; an empty range gives 0."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit keys (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z to a-z
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
#: Multiplier of the words' polynomial hash, and its inverse modulo 2**64.
_BASE = 0x9FB21C651E98DF25
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Longer words are hashed one by one.
_LONG = 64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin."""
    return word_spans(texts, lower)[:2]


def word_spans(texts: pa.Array, lower: bool, tails: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``word_hashes``, and the first byte of each word and the one after its last.

    With ``tails`` a last ``.`` or ``,`` behind an ASCII letter is a word of its own.

    All words are hashed at once: prefix sums of a polynomial over the bytes, scaled back to each word's start.
    """
    data, offsets = buffers(filled(texts))
    if lower:
        data = _LOWER[data]
    solid = ~_BLANK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.diff(offsets) > 0
    first[offsets[:-1][full]] = solid[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = solid[offsets[1:][full] - 1]
    if tails:
        tail = np.flatnonzero(last & ~first & ((data == 46) | (data == 44)))
        before = data[tail - 1] | 32
        tail = tail[(before >= 97) & (before <= 122)]
        first[tail] = last[tail - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=total[1:])
    out = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out, np.searchsorted(start, offsets), start, end
