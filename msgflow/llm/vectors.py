"""Vector columns: which are usable, and how they travel as bytes and become numpy matrices."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Shipped:
    """A broadcast value whose classes are sent along, so executors need not have this package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._bytes.value)
        return self._value


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has no null, NaN or infinite component."""
    def fine(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))

    return F.coalesce(F.forall(vector, fine), F.lit(False))


def not_zero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def width_of(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector; shorter ones count as filled up with zeros."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def matrix(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """The rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def to_bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    n, step = len(rows), rows.shape[1] * rows.itemsize
    offsets = (np.arange(n + 1) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def from_bytes(column: pa.Array, width: int, dtype) -> np.ndarray:
    """The matrix of :func:`to_bytes`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    step = width * np.dtype(dtype).itemsize
    if not len(column) or not step:
        return np.zeros((len(column), width), dtype)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return data[start:start + len(column) * step].view(dtype).reshape(len(column), width)


def part_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of a split group that a row belongs to, by its id."""
    with np.errstate(over="ignore"):
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (spread % parts.astype(np.uint64)).astype(np.int32)


def packed(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, parts) of consecutive groups: blocks of about ``room`` rows; a larger group is a block of several parts."""
    block, parts, now, filled = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), -1, room
    for i, n in enumerate(counts.tolist()):
        if filled + n > room:
            now, filled = now + 1, 0
        block[i], filled = now, filled + n
        if n > room:
            parts[i], filled = -(-n // room), room
    return block, parts
