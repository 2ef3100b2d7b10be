"""Vectorised word hashing inside Arrow batches.

A word is a longest run of bytes other than space and ``\\x09``-``\\x0D``; A-Z are lower-cased.  Words
are hashed from the UTF-8 bytes of a whole batch at once (prefix sums of a polynomial hash), so no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, CHUNK_BYTES * 2), base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes (one row at least).

    Yields (first row, number of rows, bytes, offsets from the first byte); null counts as empty.
    """
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row) of each word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, the same wherever the word stands."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power(_BASE, n), out=prefix[1:])
    own = (prefix[end] - prefix[start]) * _power(_BASE_INVERSE, n + 1)[start]
    return mix(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of fewer words gives its whole sequence as one."""
    n = len(hashes)
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        whole = row[: n - k + 1] == row[k - 1 :]
        total = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            total += hashes[j : n - k + 1 + j] * _WORD[j]
        out, rows = mix(total[whole]), row[: n - k + 1][whole]
    if n:
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[first, n])
        short = np.flatnonzero(count < k)
        if len(short):
            total = count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            for j in range(k - 1):
                has = count[short] > j
                total[has] += hashes[first[short[has]] + j] * _WORD[j]
            out, rows = np.r_[out, mix(total)], np.r_[rows, row[first[short]]]
            order = np.argsort(rows, kind="stable")
            out, rows = out[order], rows[order]
    return out, rows


def distinct_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted by row and value."""
    if not len(values):
        return values, rows
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]
    return values[fresh], rows[fresh]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    """An Arrow list column from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    at = pa.array(offsets, mask=None if valid is None else np.r_[~valid, False])
    return pa.ListArray.from_arrays(at, pa.array(values, type=kind))
