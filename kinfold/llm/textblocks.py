"""Whole-column text primitives in numpy, shared by the operators that scan documents.

A text column arrives as one Arrow buffer. Everything here works on that buffer of UTF-8 bytes:
word bounds, word hashes and byte n-grams come out as flat arrays with one offset array per document,
so no Python object is made for a word. Buffers are cut at document bounds into pieces of about
``PIECE_BYTES``; a longer document is a piece by itself and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

#: A-Z to a-z; other bytes stay, so UTF-8 stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the splitmix64 one): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, ``n`` of each at least."""
    for which, base in enumerate((_BASE, _BASE_INVERSE)):
        have = _powers[which]
        while len(have) < n:
            # No more than the next 65536 beyond what is needed: the tables live as long as the process.
            more = min(len(have), n - len(have) + 65536)
            have = np.concatenate([have, have[:more] * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[which] = have
    return _powers[0][:n], _powers[1][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row if that alone is longer."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def piece_of(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def translate(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), dtype=np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end).

    A word is a longest run of bytes that are not separators; it never crosses a row bound.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~separator[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes: equal spans hash alike wherever they stand.

    A polynomial over random byte values modulo 2**64, taken from prefix sums, then finalized.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _powers_to(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * powers[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` hashes, in order; rows are not told apart here."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _ODD
        out += hashes[k : k + n]
    return mix(out)


def row_of(bounds: np.ndarray, count: int) -> np.ndarray:
    """The row of each of ``count`` items when ``bounds`` has the first item of each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) if count else np.zeros(0, dtype=np.int64)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the first one of each row (one more at the end); ``offsets`` lie between characters."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]


def point_gram_indexes(points: np.ndarray, width: int, bits: int, seed: int) -> np.ndarray:
    """A bucket below 2**bits for the ``width`` code points from each position on; behind the last ones stand zeros."""
    packed = np.full(len(points), (seed * 0x632BE5AB) & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(width):
        packed[: max(0, len(points) - k)] += points[k:]
        packed *= np.uint32(0x9E3779B1)
        packed ^= packed >> np.uint32(15)
    packed *= np.uint32(0x85EBCA77)
    return packed >> np.uint32(32 - bits)


def gram_indexes(data: np.ndarray, width: int, bits: int, seed: int) -> np.ndarray:
    """A bucket below 2**bits for the ``width`` bytes (1 to 4) from each position on; the last ones wrap into zeros."""
    n = len(data)
    packed = data.astype(np.uint32)
    for k in range(1, width):
        packed[: max(0, n - k)] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    packed += np.uint32((seed * 0x632BE5AB) & 0xFFFFFFFF)
    packed *= np.uint32(0x9E3779B1)
    packed ^= packed >> np.uint32(15)
    packed *= np.uint32(0x85EBCA77)
    return packed >> np.uint32(32 - bits)


def is_in(hashes: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash among the keys, and whether it is there."""
    at = np.searchsorted(sorted_keys, hashes)
    there = np.zeros(len(hashes), dtype=bool)
    inside = at < len(sorted_keys)
    there[inside] = sorted_keys[at[inside]] == hashes[inside]
    return at, there


def release() -> None:
    """Give memory that is no longer used back to the system: workers that wait for their next task keep what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Not the C library that has this; its allocator does as it likes.
        return
