"""Words of an Arrow text column as flat numpy arrays: where they start and end, and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut into words at a time (a longer text is one piece); bounds the numpy arrays, which take about 40 times as much.
PIECE = 512 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: the finaliser of the splitmix64 generator."""
    x = x.astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_column(column) -> pa.Array:
    """One array of the column's texts, null as the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null("") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, one more than rows) and bytes of a text column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0]:offsets[-1]]


def pieces(column: pa.Array, limit: int = PIECE):
    """Row ranges (start, stop) whose texts have at most ``limit`` bytes together; a longer text is alone."""
    offsets, _ = utf8(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


class Words:
    """Cuts texts at separator bytes, after lower-casing A-Z.

    ``separators`` are bytes under 0x80, so code points are never cut.  Two
    equal words have equal hashes; two different ones collide with a chance of
    about 2^-64.
    """

    def __init__(self, separators: bytes):
        lower = np.arange(256)
        lower[65:91] += 32
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.inside = self.inside[lower]
        with np.errstate(over="ignore"):
            self.value = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)[lower]
        self.value[~self.inside] = 0
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) >= n:
            return
        n = 1 << (n - 1).bit_length()
        base = int(_BASE)
        inverse = np.uint64(pow(base, -1, 1 << 64))
        for name, step in (("_powers", _BASE), ("_inverse", inverse)):
            steps = np.full(n, step, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def cut(self, column: pa.Array):
        """(first, starts, ends, hashes): words ``first[i]:first[i + 1]`` are row i's; starts and ends are byte places."""
        offsets, data = utf8(column)
        if not len(data):
            none = np.zeros(0, np.int64)
            return np.zeros(len(column) + 1, np.int64), none, none, np.zeros(0, np.uint64)
        inside = self.inside[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edges] = inside[edges]
        edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[edges] = inside[edges]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self._grow(len(data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.take(self.value, data, out=sums[1:])
            sums[1:] *= self._powers[:len(data)]
            np.cumsum(sums[1:], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self._inverse[starts]
            hashes = mixed(hashes + (ends - starts).astype(np.uint64) * _M1)
        return np.searchsorted(starts, offsets), starts, ends, hashes


def runs_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, by its first word; runs that cross rows are the caller's to drop."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(length) * _M2, np.uint64)
        for i in range(length):
            total = mixed(total * _BASE + hashes[i:i + n])
    return total
