"""Vectorised text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string arrays.  They are handled as one UTF-8 byte
buffer plus row offsets, in slices of a bounded number of bytes, so that no
Python string object is made per word and memory does not depend on how many
rows an Arrow batch holds.  A *word* is a maximal run of bytes other than
ASCII white space (0x20, 0x09-0x0D), which in UTF-8 is the same as a maximal
run of such code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        steps = np.full(size, _BASE, _U)
        steps[0] = 1
        _pow = np.cumprod(steps, dtype=_U)
        steps[1:] = _BASE_INV
        _inv = np.cumprod(steps, dtype=_U)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


@dataclass
class Slice:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and ``hi - lo + 1`` offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    def row_bytes(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string array into runs of whole rows of about ``most`` bytes.

    A null counts as an empty text.  A row longer than ``most`` is a slice of
    its own: rows are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    texts = texts.cast(pa.large_string())
    _, offbuf, databuf = texts.buffers()
    offs = np.frombuffer(offbuf, np.int64, n + 1, texts.offset * 8).astype(np.int64)
    data = np.frombuffer(databuf, np.uint8) if databuf is not None and databuf.size else np.zeros(0, np.uint8)
    if texts.null_count:
        gone = np.asarray(texts.is_null())
        if (np.diff(offs)[gone] != 0).any():
            yield from slices(texts.fill_null(""), most)
            return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def spans_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that stay in one row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offs[:-1][offs[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a slice, in order."""
    return spans_of(~IS_SPACE[s.data], s.offs)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`span_hash`."""
    pw, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * pw[: len(data)], dtype=_U, out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they lie."""
    _, inv = _powers(len(pre))
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def rows_of(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The row in which each byte position (the start of a non-empty span) lies."""
    return np.searchsorted(offs, positions, "right") - 1


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a value per byte (or item) over the rows that ``offs`` delimits."""
    pre = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, dtype=np.int64, out=pre[1:])
    return pre[offs[1:]] - pre[offs[:-1]]


def word_offsets(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row the index of its first word, and at last the number of words."""
    return np.searchsorted(starts, offs, "left")


def shingles(wh: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows of each row, and offsets by row.

    A row of 1 to ``k - 1`` words has one shingle of all its words.
    """
    n = np.diff(woffs)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=offs[1:])
    total = int(offs[-1])
    if total == 0:
        return np.zeros(0, _U), offs
    row = np.repeat(np.arange(len(n)), counts)
    at = woffs[row] + (np.arange(total) - offs[row])
    padded = np.concatenate([wh, np.zeros(k, _U)])
    h = np.zeros(total, _U)
    short = n[row] < k
    for j in range(k):
        w = padded[at + j]
        if short.any():
            w = np.where(short & (j >= n[row]), _U(0), w)
        h = mix(h * _U(0xC2B2AE3D27D4EB4F) + w)
    return h, offs


def unique_per_row(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, their counts, and offsets by row."""
    if len(h) == 0:
        return h, np.zeros(0, np.int64), offs.copy()
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hs)))
    out = np.zeros(len(offs), np.int64)
    np.cumsum(np.bincount(rs[at], minlength=len(offs) - 1), out=out[1:])
    return hs[at], counts, out
