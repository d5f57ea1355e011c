"""Vectorised views and hashes over the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a longer document is cut at a separator.
CHUNK = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, a null being an empty text; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows of about `limit` bytes in a column together, or to one row, so that a task's memory goes by
    the limit, not by the rows of a batch. What earlier tasks left free in this worker goes back to the system."""
    release()
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for i, lo in enumerate(heads):
            yield batch.slice(int(lo), int((heads[i + 1] if i + 1 < len(heads) else len(part)) - lo))
    release()


def release() -> None:
    """Gives freed memory back to the system, as far as its library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser for 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _ODD, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _ranges(raw: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about CHUNK that end at a document's end or after a separator."""
    start, total = 0, int(offsets[-1])
    while start < total:
        end = int(offsets[min(np.searchsorted(offsets, start + CHUNK, "left"), len(offsets) - 1)])
        if end - start > 8 * CHUNK:
            first = int(offsets[np.searchsorted(offsets, start, "right")])
            if first - start > 8 * CHUNK:
                probe, end = start + 8 * CHUNK, first
                while probe < first:
                    found = np.flatnonzero(_SEPARATOR[raw[probe : min(probe + CHUNK, first)]])
                    if len(found):
                        end = probe + int(found[0]) + 1
                        break
                    probe += CHUNK
            else:
                end = int(offsets[np.searchsorted(offsets, start + 8 * CHUNK, "right") - 1])
        yield start, end
        start = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every document (A-Z lower-cased, cut at 0x20 and 0x09-0x0D), and
    each document's first index into them (one entry more than documents)."""
    hashes, begins = [], []
    cuts = offsets[1:-1]
    for start, end in _ranges(raw, offsets):
        part = _LOWER[raw[start:end]]
        inside = ~_SEPARATOR[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[[0, -1]] = True
        lo, hi = np.searchsorted(cuts, [start, end])
        edge[cuts[lo:hi] - start] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
        first = np.flatnonzero(inside & ~before)
        if not len(first):
            continue
        length = np.flatnonzero(inside & ~after) + 1 - first
        power = _power(int(length.max()))
        place = np.arange(int(length.sum()), dtype=np.int64)
        heads = np.cumsum(length) - length
        place -= np.repeat(heads, length)
        value = (part[inside].astype(np.uint64) + np.uint64(1)) * power[place]
        hashes.append(mix(np.add.reduceat(value, heads) + length.astype(np.uint64)))
        begins.append(first + start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(at, offsets, "left")


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs of one document; with fewer words, of its whole sequence; none without words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - n + 1 + i]
        out ^= out >> np.uint64(32)
    return mix(out)
