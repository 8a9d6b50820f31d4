"""Words and shingles of Arrow string columns as numpy arrays over their UTF-8 bytes.

Words are runs of anything but ASCII white space (0x20, 0x09-0x0D).  ``piece_hashes`` are 64 bits
wide and stand for contents: pieces of up to 8 bytes differ in hash where they differ, longer
ones are mixed block by block, and those of more than 64 bytes go through BLAKE2b.
``rolling_hashes`` are a polynomial modulo 2**64, for which colliding texts can be constructed
(Thue-Morse words); they only choose places and never stand for contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, CHUNK + 1)
        found = np.empty(size, np.uint64)
        found[0] = 1
        found[1:] = np.uint64(base)
        np.cumprod(found, out=found)
        if size <= 4 * CHUNK:  # the table of one very long document is not kept
            _powers[base] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and where each begins; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive values of at most ``limit`` bytes together (or one longer value)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each word, its end, index of the first word of each value and the total)."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[1:] = space
    edge[0] = True
    edge[offsets] = True
    before = edge[:-1]
    begins = np.flatnonzero(before & ~space)
    edge[:-1] = space
    edge[n] = True
    edge[offsets] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def rolling_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of data[b:e] for each pair, from prefix sums of a polynomial modulo 2**64: cheap at every byte."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(_BASE, n)[:n], out=sums[1:])
    value = (sums[ends] - sums[begins]) * _table(_INVERSE, n + 1)[begins]
    return mix(value + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of a piece that are mixed in numpy; longer ones are digested one by one.
_MIXED = 64


def piece_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[b:e] for each pair."""
    sizes = ends - begins
    value = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    rows = np.flatnonzero((sizes > 0) & (sizes <= _MIXED))
    at, left = begins[rows], sizes[rows]
    while len(rows):
        block = eights[at]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        value[rows] = mix(value[rows] * np.uint64(0x9FB21C651E98DF25) ^ block)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(sizes > _MIXED)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        value[long] = np.frombuffer(b"".join(
            hashlib.blake2b(view[b:e], digest_size=8).digest()
            for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True)
        ), "<u8")
    return value


def _joined(hashes: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    value = hashes[begins]
    for step in range(1, k):
        value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[begins + step])
    return value


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, index of the first of each value and the total).
    A value with 1 to k - 1 words has one shingle, its whole sequence; one without, none."""
    begins, ends, first = words(data, offsets)
    hashes = piece_hashes(data, begins, ends)
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(runs)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    out = np.empty(at[-1], np.uint64)
    long = np.repeat(counts >= k, runs)
    start = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    out[long] = _joined(hashes, start[long], k)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[at[i]] = mix(_joined(hashes, first[i : i + 1], int(counts[i])) + np.uint64(counts[i]))[0]
    return out, at


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each value."""
    data, offsets = utf8(column)
    for _, _, part, at in chunks(data, offsets):
        found, where = shingles(lowered(part) if lower else part, at, k)
        for i in range(len(at) - 1):
            own = np.sort(found[where[i] : where[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
