"""Word, line and window hashing over the UTF-8 bytes of Arrow text columns.

The word classes used by the operators are all decided by single ASCII bytes, so words can be found with a byte table
on the raw Arrow buffer, for many documents at once, without making Python strings. Work is done in slices of about
``SLICE_BYTES`` so that memory stays bounded by that, or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

#: A-Z to a-z, everything else itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = False
ALNUM[0x3A:0x61] = False
ALNUM[0x7B:0x80] = False


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, dtype=np.uint64), np.full(n, _P_INV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for at least ``n`` positions."""
    return _powers(max(SLICE_BYTES + 1, n))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads the linear hashes below over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """Consecutive documents as one byte buffer: document ``i`` is ``buf[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and ``first``: document ``i`` has the words ``first[i]:first[i + 1]``."""
        return self._runs(table[self.buf])

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.buf)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1] | edge[1:n]
            end[:-1] &= ~inside[1:] | edge[1:n]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of ``\\n``-split lines (an empty document has one empty line), and ``first`` as above."""
        cut = np.flatnonzero(self.buf == 10)
        per_doc = np.searchsorted(cut, self.offsets)
        first = per_doc + np.arange(len(self.offsets))
        starts = np.empty(first[-1], dtype=np.int64)
        ends = np.empty(first[-1], dtype=np.int64)
        doc = np.searchsorted(self.offsets[1:-1], cut, side="right") if len(self) > 1 else np.zeros(len(cut), np.int64)
        # a line break of document d that is the j-th overall ends line j + d
        at = np.arange(len(cut)) + doc
        ends[at], starts[at + 1] = cut, cut + 1
        starts[first[:-1]], ends[first[1:] - 1] = self.offsets[:-1], self.offsets[1:]
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span, equal for equal bytes."""
        up, down = powers(len(self.buf) + 1)
        if self._prefix is None:
            prefix = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=prefix[1:])
            self._prefix = prefix
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts])

    def text(self, start: int, end: int) -> str:
        return self.buf[start:end].tobytes().decode("utf-8", "replace")


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes (none if there are fewer words)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : i + n]
    return mix(out)


def text_slices(batch: pa.RecordBatch, column: str, lower: bool = False) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of a batch with their texts, nulls as empty, each of about ``SLICE_BYTES`` unless one text is longer."""
    data = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    n = len(data)
    if not n:
        return
    _, raw_offsets, raw = data.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[data.offset : data.offset + n + 1]
    everything = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(everything[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower)
        lo = hi
