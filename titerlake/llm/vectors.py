"""Vectors in Arrow list columns as numpy matrices, and how rows are dealt to shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers; false, never null, where not."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(good, F.lit(False))


def longest(*arrays: pa.Array | pa.ChunkedArray) -> int:
    """Components of the longest vector of all ``arrays``."""
    return max((pc.max(pc.list_value_length(a)).as_py() or 0 for a in arrays), default=0)


def matrix(array: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of doubles, as wide as the longest vector (or ``width``); shorter ones end in zeros."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(array), 0), np.int64)
    flat = np.asarray(pc.fill_null(array.flatten(), 0).cast(pa.float64()))
    width = max(int(sizes.max(initial=0)), width or 0, 1)
    out = np.zeros((len(sizes), width))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def one_per_id(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions of one row for each id, ascending: of rows that share one, the least by ``keys`` (vectors or scalars)."""
    if len(np.unique(ids)) == len(ids):
        return np.argsort(ids, kind="stable")
    columns = [c for key in keys for c in (key.T if key.ndim == 2 else [key])]
    order = np.lexsort([*reversed(columns), ids])
    sorted_ids = ids[order]
    return order[np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]])]


def dealt(column: str, parts: int, salt: int) -> Column:
    """The part of a row by the hash of its id; equal ids share one."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(parts)).cast("int")
