"""Vectorised text helpers for Arrow batches: words, word hashes, document slices.

All functions work on the UTF-8 bytes of a whole batch at once (NumPy), never word by word in Python.
Hashes are 64-bit: polynomial over random byte codes, finished with a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: bytes of text handled at once; a single longer text is still handled whole
BLOCK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def white_space() -> np.ndarray:
    """Separator table of the word class [^\\x20\\x09-\\x0D]+."""
    sep = np.zeros(256, bool)
    sep[[0x20, 9, 10, 11, 12, 13]] = True
    return sep


def non_alphanumeric() -> np.ndarray:
    """Separator table of the word class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ on lower-cased text."""
    sep = np.zeros(256, bool)
    sep[:0x80] = True
    sep[0x30:0x3A] = False
    sep[0x61:0x7B] = False
    return sep


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


_POW: dict[int, np.ndarray] = {}


def _cached_powers(n: int, base: np.uint64) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        have = powers(max(n, BLOCK_BYTES + 1) if n <= 2 * BLOCK_BYTES else n, base)
        if n <= 2 * BLOCK_BYTES:  # do not keep the table of an unusually long text
            _POW[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer for uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batches, rows: int = 1024):
    """The same rows in smaller batches, so that what is made of a batch stays small; at the end Arrow's free memory goes
    back, as the worker that ran the task is kept."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def blocks(offs: np.ndarray, size: int = BLOCK_BYTES):
    """Row ranges (first, past last) of about ``size`` bytes; a longer text is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into the words): maximal runs of non-separators, none across rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow strings of the given byte lengths that stand one after the other in ``data``."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums P of codes[i] * base**i (length n + 1); see :func:`range_hash`."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _cached_powers(len(codes), _BASE), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the run stands."""
    inv = _cached_powers(len(prefix), _BASE_INV)
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(_BYTE_CODE[data]), starts, ends)


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def window_rows(row_offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, rows) of all windows of ``length`` items inside one row of a ragged array."""
    counts = np.maximum(np.diff(row_offs) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[rows] + row_offs[:-1][rows], rows


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions 0..n-1 inside any [start, end)."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def window_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """:func:`range_hash` of every run of ``length`` codes, by contiguous passes."""
    n = len(prefix) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[length:] - prefix[:-length]) * _cached_powers(n, _BASE_INV) + np.uint64(length))


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each of the n - width + 1 windows of ``width`` hashes: index of its smallest, the rightmost of equals.

    Leading hash bits and the place (from the right) make one key; minima come from the prefix and suffix
    minima of blocks of ``width``, so the cost does not depend on it."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = ((hashes >> bits) << bits) | (low - np.arange(n, dtype=np.uint64))
    key = np.append(key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    before = np.minimum.accumulate(key, axis=1).ravel()
    after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(after[:n - width + 1], before[width - 1:n])
    return (low - (best & low)).astype(np.int64)
