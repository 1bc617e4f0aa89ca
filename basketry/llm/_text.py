"""Tokens and hashes of whole Arrow string columns, computed on the UTF-8 bytes with numpy.

A token's hash is a polynomial over random 64-bit values of its bytes, taken from running sums,
so that neither tokenizing nor hashing loops over tokens in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_libc = ctypes.CDLL(None)
# Texts are worked on in runs of about this many bytes, so that temporaries stay small.
CHUNK_BYTES = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that every bit depends on all bits."""
    with np.errstate(over="ignore"):
        v = values.astype(U64, copy=True)
        v ^= v >> U64(30)
        v *= U64(0xBF58476D1CE4E5B9)
        v ^= v >> U64(27)
        v *= U64(0x94D049BB133111EB)
        v ^= v >> U64(31)
    return v


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, size: int) -> np.ndarray:
    if len(_powers[kind]) < size:
        step = _BASE if kind == "up" else _BASE_INVERSE
        table = np.full(max(size, CHUNK_BYTES * 2), step, U64)
        table[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(table)
    return _powers[kind][:size]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the ``n + 1`` offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system: workers are used again and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):
        trim(0)


def runs(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes each."""
    data, at = buffers(column)
    rows, i = len(at) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    give_back()


class Tokens(NamedTuple):
    row: np.ndarray  # row of each token
    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    sums: np.ndarray  # running sums of the bytes' terms
    first: np.ndarray  # of each row the number of its first token, and the total


def tokens(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True) -> Tokens:
    """Maximal runs of bytes for which ``inside`` holds; a row's end also ends a token."""
    n = len(data)
    within = np.zeros(n + 2, bool)
    within[1:-1] = inside[data]
    opens = np.empty(n + 1, bool)  # a token starts at this byte
    opens[:] = within[1:] & ~within[:-1]
    closes = np.empty(n + 1, bool)  # a token ends before this byte
    closes[:] = within[:-1] & ~within[1:]
    cuts = at[1:-1]
    opens[cuts] = within[cuts + 1]
    closes[cuts] = within[cuts]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    row = np.searchsorted(at, start, "right") - 1
    # Empty rows share an offset with the next; the last of them owns the byte.
    first = np.searchsorted(row, np.arange(len(at)))
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUE[LOWER[data] if lower else data] * _power("up", n), out=sums[1:])
    return Tokens(row, start, end, sums, first)


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        terms = (sums[end] - sums[start]) * _power("down", len(sums) + 1)[start]
        return mix(terms + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of a row, and of each row its first shingle.

    A row with fewer words, but some, has one shingle: all its words.
    """
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    out = np.zeros(begin[-1], U64)
    length = np.minimum(count, width)[row]
    with np.errstate(over="ignore"):
        for k in range(width):
            use = length > k
            if use.all():
                out = out * _BASE + words[at + k]
            else:
                out[use] = out[use] * _BASE + words[at[use] + k]
        out = mix(out + length.astype(U64))
    return out, begin


def char_offsets(data: np.ndarray) -> np.ndarray:
    """For each byte position the number of code points before it in the run."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def crc_bucket(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for null ids."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary")) % modulus
