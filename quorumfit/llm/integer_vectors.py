"""Embeddings as exact integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of products stay below this, so that they and their differences fit a long.
LARGEST = 1 << 60


def whole(vector: Column) -> Column:
    """True for a vector that is there and has no null, NaN or infinite component."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of every component x, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0))


def matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as an integer matrix; short rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < lens[:, None]] = flat
    return out


def check_range(largest: int, dims: int, name: str) -> None:
    """Refuse components whose squared distances would not fit a long."""
    if 4 * largest * largest * max(dims, 1) >= LARGEST:
        raise ValueError(f"{name}: integer components up to {largest} are too large for long scores")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b of integer arrays: through doubles while every sum stays below 2^53."""
    if not a.size or not b.size:
        return a @ b
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[-1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b
