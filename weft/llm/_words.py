"""Vectorised tokenising of Arrow string columns: words, lines and their 64-bit hashes straight from UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text makes one larger chunk.
CHUNK_BYTES = 1 << 19

U = np.uint64
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


_BYTE_VALUE = _splitmix(256, 0x51ED2701)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside words of the class [^\x20\x09-\x0D].
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes inside words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all that isn't ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = {_P: np.ones(1, dtype=U), _P_INV: np.ones(1, dtype=U)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 mod 2**64; grown when needed."""
    have = _powers[base]
    if len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base & _M, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes, one row at least."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of a chunk, in order: byte spans, hashes, and the range of words of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_first: np.ndarray  # n + 1 entries: row r has words row_first[r] .. row_first[r+1]-1


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, dtype=U)
    np.multiply(_BYTE_VALUE[data], _power(_P, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * _power(_P_INV, len(data) + 1)[start] + (end - start).astype(U))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Words are maximal runs, within a row, of bytes of which ``inside`` is true after lower-casing A-Z."""
    if lower:
        data = LOWER[data]
    m = inside[data]
    n = len(m)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = m[edge]
    last[edge - 1] = m[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(start, end, spans_hash(data, start, end), np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, row_first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``width`` consecutive words of a row (all the row's words if it has fewer, none if it has none), and the windows' n + 1 row bounds."""
    n = np.diff(row_first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    total = int(bounds[-1])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - bounds[:-1][row] + row_first[:-1][row]
    end = row_first[1:][row]
    out = np.zeros(total, dtype=U)
    for k in range(width):
        pos = at + k
        have = pos < end
        value = hashes[np.minimum(pos, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(have, mix(out * U(0xD6E8FEB86659FD93) + value + U(k + 1)), out)
    return out, bounds


def distinct_sorted(key: np.ndarray, group: np.ndarray, n_groups: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each group (ids 0..n_groups-1, non-decreasing), sorted by (order, key) within it, and the n + 1 group
    bounds. order: 0 to 255, a function of the key."""
    bits = max(1, int(n_groups - 1).bit_length())
    if bits <= 24:
        # One sort of packed values; in the rare case that different keys look equal in it, the full one.
        packed = (group.astype(U) << U(64 - bits)) | (order.astype(U) << U(56 - bits)) | (key >> U(8 + bits))
        by = np.argsort(packed)
        packed, k, g = packed[by], key[by], group[by]
        same = packed[1:] == packed[:-1]
        if not (same & (k[1:] != k[:-1])).any():
            new = np.ones(len(k), dtype=bool)
            new[1:] = ~same
            k, g = k[new], g[new]
            return k, np.searchsorted(g, np.arange(n_groups + 1))
    by = np.lexsort((key, order, group))
    key, group = key[by], group[by]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    key, group = key[new], group[new]
    return key, np.searchsorted(group, np.arange(n_groups + 1))
