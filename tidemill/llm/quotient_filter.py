"""Counting quotient filters over packed n-grams: lossless, compact and mergeable.

An n-gram of word ids of ``bits`` each is one number of n * bits. A Feistel network permutes these numbers, so they are
spread evenly whatever the words are, and can be permuted back. The first bits of a permuted number are its quotient,
the bucket that it is in, and are stored only as how many numbers each bucket has; the rest, the full remainder, is
stored in as few bytes as hold it, beside the count. Nothing is lost, so equal entries of two filters are equal n-grams
and sorted filters are merged like sorted lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemill.llm.bytewords import mix

ROUNDS = 3
_U = np.uint64
#: A count of this or more is kept aside; the others take a byte.
_LARGE = 255


def _mask(width: int) -> np.uint64:
    return _U((1 << width) - 1)


@dataclass(frozen=True)
class Shape:
    """n-grams of ``n`` ids of ``bits`` (64 at most): two lanes or more of even width hold the number, first bits first."""

    n: int
    bits: int

    @property
    def widths(self) -> list[int]:
        p = self.n * self.bits
        lanes = max(2, -(-p // 64))
        return [p // lanes + (i < p % lanes) for i in range(lanes)]

    def _moves(self) -> list[tuple[int, int, int, int, int]]:
        """(id, lane, how far to the left of the id's end and of the lane's end their common bits end, number of them)."""
        out, begin = [], 0
        for lane, w in enumerate(self.widths):
            for j in range(self.n):
                lo, hi = max(begin, j * self.bits), min(begin + w, (j + 1) * self.bits)
                if lo < hi:
                    out.append((j, lane, (j + 1) * self.bits - hi, begin + w - hi, hi - lo))
            begin += w
        return out

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        lanes = [np.zeros(len(ids[0]), _U) for _ in self.widths]
        for j, lane, a, b, k in self._moves():
            lanes[lane] |= ((ids[j] >> _U(a)) & _mask(k)) << _U(b)
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        ids = [np.zeros(len(lanes[0]), _U) for _ in range(self.n)]
        for j, lane, a, b, k in self._moves():
            ids[j] |= ((lanes[lane] >> _U(b)) & _mask(k)) << _U(a)
        return ids

    def _changed(self, lanes: list[np.ndarray], i: int, turn: int) -> np.ndarray:
        h = np.full(len(lanes[0]), (turn * 64 + i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), _U)
        for k, x in enumerate(lanes):
            if k != i:
                h = mix(h + x)
        return lanes[i] ^ (h & _mask(self.widths[i]))

    def permute(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = list(lanes)
        for turn in range(ROUNDS):
            for i in range(len(lanes)):
                lanes[i] = self._changed(lanes, i, turn)
        return lanes

    def restore(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = list(lanes)
        for turn in reversed(range(ROUNDS)):
            for i in reversed(range(len(lanes))):
                lanes[i] = self._changed(lanes, i, turn)
        return lanes


def summed(shape: Shape, lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted numbers in order, each once, with how often it is there or the sum of its counts."""
    if not len(lanes[0]):
        return lanes, np.empty(0, _U)
    if shape.n * shape.bits <= 64:
        whole = (lanes[0] << _U(shape.widths[1])) | lanes[1]
        order = np.argsort(whole, kind="stable") if counts is not None else None
        whole = np.sort(whole) if order is None else whole[order]
        new = np.concatenate([[True], whole[1:] != whole[:-1]])
        kept = whole[new]
        lanes = [kept >> _U(shape.widths[1]), kept & _mask(shape.widths[1])]
    else:
        order = np.lexsort(lanes[::-1])
        lanes = [x[order] for x in lanes]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in lanes], axis=0)
        n = len(order)
        lanes = [x[new] for x in lanes]
    at = np.flatnonzero(new)
    if counts is None:
        return lanes, np.diff(np.append(at, len(new))).astype(_U)
    return lanes, np.add.reduceat(counts[order], at)


def _to_bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)].tobytes()


def _from_bytes(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    k = -(-width // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(data, np.uint8, n * k, at).reshape(n, k)
    return out.view("<u8").ravel().astype(_U), at + n * k


def encode(shape: Shape, lanes: list[np.ndarray], counts: np.ndarray, known: int) -> bytes:
    """A filter of sorted permuted numbers that all have the same first ``known`` bits, which aren't stored."""
    n, w = len(counts), shape.widths[0]
    q = max(0, min(w - known, max(1, n).bit_length() - 1))  # about one number a bucket
    bucket = (lanes[0] >> _U(w - known - q)) & _mask(q)
    held = np.bincount(bucket.astype(np.int64), minlength=1 << q).astype("<u4")
    wide = held.max(initial=0) > 255
    large = counts >= _LARGE
    parts = [
        np.array([n, q, wide, large.sum()], "<u4").tobytes(),
        held.tobytes() if wide else held.astype(np.uint8).tobytes(),
        _to_bytes(lanes[0] & _mask(w - known - q), w - known - q),
        *[_to_bytes(x, k) for x, k in zip(lanes[1:], shape.widths[1:], strict=True)],
        np.minimum(counts, _U(_LARGE)).astype(np.uint8).tobytes(),
        counts[large].astype("<u8").tobytes(),
    ]
    return b"".join(parts)


def decode(shape: Shape, data: bytes, first: int, known: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted numbers, whose first ``known`` bits are ``first``, and counts of a filter."""
    n, q, wide, large = (int(x) for x in np.frombuffer(data, "<u4", 4))
    w = shape.widths[0]
    held = np.frombuffer(data, "<u4" if wide else np.uint8, 1 << q, 16)
    at = 16 + held.nbytes
    rest, at = _from_bytes(data, at, n, w - known - q)
    bucket = np.repeat(np.arange(1 << q, dtype=_U), held.astype(np.int64))
    lanes = [(_U(first) << _U(w - known)) | (bucket << _U(w - known - q)) | rest]
    for k in shape.widths[1:]:
        x, at = _from_bytes(data, at, n, k)
        lanes.append(x)
    counts = np.frombuffer(data, np.uint8, n, at).astype(_U)
    counts[counts == _LARGE] = np.frombuffer(data, "<u8", large, at + n)
    return lanes, counts


def merge(shape: Shape, blocks: list[bytes], first: int, known: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Several filters of the same first bits as one."""
    read = [decode(shape, b, first, known) for b in blocks]
    lanes = [np.concatenate(x) for x in zip(*(r[0] for r in read), strict=True)]
    return summed(shape, lanes, np.concatenate([r[1] for r in read]))
