"""Vectorised text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Everything here works on the raw UTF-8
bytes of many texts at once, a bounded slice at a time, so that neither the
number of rows in a batch nor the length of one text decides how much memory a
task takes (a few hundred bytes per word of the slice in hand).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  None of these
bytes occurs inside a multi-byte UTF-8 sequence, so splitting bytes equals
splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_BYTE_LOWER = _BYTE[LOWER]
_ORDER = constants(64, 23)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, n) + 1
    if size > SLICE_BYTES + 1:
        return _powers(_BASE, size), _powers(_INVERSE, size)
    if size not in _POWERS:
        _POWERS[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POWERS[size]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about limit bytes."""
    n = len(column)
    if not n:
        return
    buf, offsets = raw(column)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = IS_SPACE[buf]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    cut = offsets[1:-1]
    first[cut[cut < n]] = True
    first &= ~space
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    last[cut[cut > 0] - 1] = True
    last &= ~space
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        size = int(ends[j - 1] - base)
        up, down = _power_tables(size)
        run = np.empty(size + 1, np.uint64)
        run[0] = 0
        np.multiply(table[buf[base : base + size]], up[:size], out=run[1:])
        np.cumsum(run, out=run)
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each row the index of its first word (one more entry than rows)."""
    starts, ends, rows = spans(buf, offsets)
    return span_hashes(buf, starts, ends, lower), np.searchsorted(rows, np.arange(len(offsets)), side="left")


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, regardless of rows; len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * _ORDER[0]
    for k in range(1, n):
        out += words[k : k + m] * _ORDER[k]
    return mix(out)


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int = 5, lower: bool = True, whole_short: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles) for each row in order.

    A text of fewer words than n has its whole word sequence as the one shingle
    (none with whole_short false); without words the set is empty.
    """
    for lo, hi, buf, offsets in slices(column):
        words, at = word_hashes(buf, offsets, lower)
        grams = ngram_hashes(words, n)
        for k in range(hi - lo):
            a, b = at[k], at[k + 1]
            if b - a >= n:
                yield lo + k, np.unique(grams[a : b - n + 1])
            elif b > a and whole_short:
                yield lo + k, mix(np.array([np.sum(words[a:b] * _ORDER[: b - a])], np.uint64) + np.uint64(b - a))
            else:
                yield lo + k, np.zeros(0, np.uint64)


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
