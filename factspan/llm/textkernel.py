"""Numpy kernels over Arrow string columns: tokens, hashes and segment sums without one Python object per word.

A column is seen as one byte buffer with row offsets.  Work goes in slices of bounded size, so memory in a
task follows ``SLICE_BYTES`` or the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
PAD = 16
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

#: Bytes of words that are runs of anything but the six ASCII white-space characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def release() -> None:
    """Gives freed memory back to the system, which allocators else keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty.  The bytes are a read-only view."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, dtype=kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row if that row is longer."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1, lo + 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def cut(buf: np.ndarray, offsets: np.ndarray, limit: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts with those longer than ``limit`` cut behind bytes of ``ends``, and the row of each part.  A part is
    longer only where it has no such byte."""
    if len(offsets) < 2 or np.diff(offsets).max() <= limit:
        return offsets, np.arange(len(offsets) - 1)
    cuts, rows = [0], []
    for r, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        if hi - lo > limit:
            places = np.flatnonzero(ends[buf[lo:hi]]) + lo + 1
            at = lo
            while hi - at > limit:
                k = int(np.searchsorted(places, at + limit))
                if k == len(places) or places[k] >= hi:
                    break
                at = int(places[k])
                cuts.append(at)
                rows.append(r)
        cuts.append(hi)
        rows.append(r)
    return np.array(cuts, dtype=np.int64), np.array(rows, dtype=np.int64)


def padded(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """A copy with zero bytes after it, so that eight bytes can be loaded at any position."""
    out = np.zeros(len(buf) + PAD, dtype=np.uint8)
    out[:len(buf)] = LOWER_AZ[buf] if lower else buf
    return out


class Tokens:
    """Maximal runs of bytes of ``table`` within each row: ``start``, ``end`` and, per row, ``first``."""

    def __init__(self, pad: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = int(offsets[-1])
        inside = table[pad[:n]]
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = edge[n] = True
        if n:
            np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        left, right = cuts[:-1], cuts[1:]
        keep = inside[left] if n else np.zeros(0, bool)
        self.start, self.end = left[keep], right[keep]
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def load8(pad: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one little-endian number."""
    return np.ndarray((len(pad) - 7,), dtype="<u8", buffer=pad, strides=(1,))


def hash_spans(pad: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes."""
    words = load8(pad)
    left = end - start
    h = mix(left.astype(np.uint64) + np.uint64(seed))
    at, live = start, None
    while len(at):
        lane = words[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ lane)
            more = np.flatnonzero(left > 8)
            live = more
        else:
            h[live] = mix(h[live] ^ lane)
            more = np.flatnonzero(left > 8)
            live = live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def same_spans(pad_a: np.ndarray, a0: np.ndarray, a1: np.ndarray, pad_b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether byte spans are equal, byte for byte."""
    same = (a1 - a0) == (b1 - b0)
    live = np.flatnonzero(same)
    la, lb = load8(pad_a), load8(pad_b)
    p, q, left = a0[live], b0[live], (a1 - a0)[live]
    while len(live):
        mask = _MASKS[np.minimum(left, 8)]
        ok = (la[p] & mask) == (lb[q] & mask)
        same[live[~ok]] = False
        go = ok & (left > 8)
        live, p, q, left = live[go], p[go] + 8, q[go] + 8, left[go] - 8
    return same


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; entry i covers words i to i+k-1."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return out


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments that start at ``first[i]`` and end at ``first[i+1]``; empty ones are 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.result_type(values.dtype, np.int64) if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def crc32_ids(ids: list) -> np.ndarray:
    """crc32 of each id as decimal text; a null id counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], dtype=np.int64)
