"""Whole Arrow string columns as numpy byte arrays: word bounds and hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in groups of about so many bytes, so that memory doesn't depend on the Arrow batch.
GROUP_BYTES = 1 << 20
#: The same where a byte makes some hundred bytes of features.
SCORED_BYTES = 1 << 18

BASE = 0x9E3779B97F4A7C15 | 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, row offsets of length n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each, or of one longer row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; one table per worker, not kept for texts far beyond a group."""
    global _powers
    if _powers.shape[1] >= n:
        return _powers
    steps = np.repeat(np.array([[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64), n, axis=1)
    steps[:, 0] = 1
    np.multiply.accumulate(steps, axis=1, out=steps)
    if n <= 4 * GROUP_BYTES:
        _powers = steps
    return steps


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any byte ranges of one array, equal for equal bytes: prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_table(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        steps = data.astype(np.uint64)
        steps += np.uint64(1)
        steps *= up[: len(data)]
        np.cumsum(steps, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def runs(mask: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of set bytes; a run never goes over a row's start."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = row_starts[row_starts < n]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    cut = inner[inner > 0] - 1
    after[cut] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def byte_table(pattern_bytes: bytes) -> np.ndarray:
    """256 booleans: the bytes given are set."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern_bytes, np.uint8)] = True
    return out


def bucket(values: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Hash non-negative integers of a feature kind to ``bits`` bits."""
    h = (values.astype(np.uint64) + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def unique_pairs(rows: np.ndarray, features: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, feature) once, by row."""
    keys = np.unique((rows << bits) | features)
    return keys >> bits, keys & ((1 << bits) - 1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with a line feed after each row, row starts): no pattern without line feeds can match over two rows."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    return out, offsets[:-1] + np.arange(n)


def text_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte (length n + 1)."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))
