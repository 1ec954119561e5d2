"""Vectorised word and shingle keys over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` with A-Z
lower-cased; both are safe on UTF-8 bytes because those bytes never occur inside
a multi-byte character.  Keys are 64-bit, so two different words share a key with
probability about n^2 / 2^65.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def lean(run):
    """`run` (batches -> batches), giving freed memory back to the system when it ends.

    Workers are reused from task to task, and what their allocator keeps adds up beside the
    executor's heap.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so low and high bits are both usable."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(max(n, 5 << 18), base, U)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets of each text); nulls are empty."""
    column = as_array(column)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, most: int = 1 << 20):
    """Row ranges of at most about `most` bytes of text (always one row at least)."""
    _, ends = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(key of every word in text order, number of words before each row and in all)."""
    raw, ends = text_bytes(column)
    n = len(raw)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    inside = ~_WS[raw]
    edge = np.zeros(n + 1, bool)  # where a new text starts
    edge[ends] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((_LOWER[raw].astype(U) + U(1)) * power[:n], out=sums[1:])
    keys = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U) * U(0xD6E8FEB86659FD93))
    return keys, np.searchsorted(first, ends)


def shingles(column: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle keys, sorted within each row; offsets of the rows).

    A row with fewer words than `width` has its whole sequence as one shingle; a row
    without words has none.
    """
    keys, at = words(column)
    counts = np.diff(at)
    rolled = np.zeros(len(keys), U)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(keys)) - np.repeat(at[:-1], counts)
    room = np.repeat(counts, counts) - place  # words from here to the end of the row
    for k in range(width):
        have = room > k
        step = np.zeros(len(keys), U)
        step[have] = keys[np.flatnonzero(have) + k] if k else keys[have]
        rolled = rolled * U(0xFF51AFD7ED558CCD) + step + have.astype(U)
    keep = (room >= width) | ((place == 0) & (np.repeat(counts, counts) < width))
    rolled, row = mix(rolled[keep]), row[keep]
    order = np.lexsort((rolled, row))
    rolled, row = rolled[order], row[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (row[1:] != row[:-1])
    rolled, row = rolled[fresh], row[fresh]
    return rolled, np.searchsorted(row, np.arange(len(counts) + 1))
