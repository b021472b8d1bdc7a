"""Operator 8: byte-level BPE encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bytewords import text_slices
from tidemill.llm.common import bounded_batches, read

#: Memory of pieces and their ids in a worker: text and ids of a piece count, and what Python adds to them. It is emptied
#: when it is full.
KEPT_BYTES, PIECE_BYTES = 32 << 20, 250


class Vocabulary:
    """The tokens of a rank file (lines of base64 token and rank) and the pattern that cuts texts into pieces."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs, ranks = array("q"), array("q")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    ranks.append(rank)
        order = np.argsort(np.array(pairs), kind="stable")
        #: pairs of ids whose bytes together are a token, sorted, and that token's rank
        self.pairs, self.pair_ranks = np.array(pairs)[order], np.array(ranks)[order].astype(np.int32)
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until no pair has a rank.

        Leaf ``i`` of the tree has rank * width + i of the pair that starts at byte ``i``, so the root names the next
        merge; after it, only the pairs that end or start there change, each in a walk from its leaf to the root.
        """
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = len(ranks) * width + width
        tree = [none] * (2 * width)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                beside = tree[at ^ 1]
                at >>= 1
                least = value if value < beside else beside
                if tree[at] == least:
                    return
                tree[at] = value = least

        def rank(i: int) -> int:
            if i < 0 or after[i] >= n:
                return none
            r = ranks.get(piece[i : after[after[i]]])
            return none if r is None else r * width + i

        while tree[1] != none:
            i = tree[1] % width
            gone = after[i]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, rank(i))
            if before[i] >= 0:
                put(before[i], rank(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The same merges for many pieces of at most ``width`` bytes at once: one row, and one tree, for each piece."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int32, n)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        none = np.int32(len(self.ranks) * width + width)
        token = np.zeros((n, width + 1), np.int32)
        token[:, :width] = self.byte_ids[raw]
        token[np.arange(width + 1)[None, :] >= sizes[:, None]] = -1
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        live = token[:, :width] >= 0
        tree = np.full((n, 2 * width), none, np.int32)
        tree[:, width:] = self._keys(token[:, :-1], token[:, 1:], np.arange(width, dtype=np.int32)[None, :], width, none)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            far = after[rows, gone]
            token[rows, at] = root // width
            after[rows, at] = far
            live[rows, gone] = False
            inner = far < width
            before[rows[inner], far[inner]] = at[inner]
            here = self._keys(token[rows, at], token[rows, np.minimum(far, width)], at, width, none)
            left = before[rows, at]
            has_left = left >= 0
            lefts = np.maximum(left, 0)
            there = self._keys(np.where(has_left, token[rows, lefts], -1), token[rows, at], lefts, width, none)
            tree[rows, width + gone] = none
            tree[rows, width + at] = here
            tree[rows[has_left], width + left[has_left]] = there[has_left]
            for leaf in (gone, at, np.where(has_left, left, at)):
                up = (leaf + width) >> 1
                while up[0]:  # all leaves are equally deep
                    tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                    up = up >> 1
            rows = rows[tree[rows, 1] < none]
        ids = token[:, :width][live].astype("<u4").tobytes()
        cuts = [0, *np.cumsum(4 * live.sum(axis=1)).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _keys(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int, none: np.int32) -> np.ndarray:
        pair = (a.astype(np.int64) << 20) | b
        where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[where] == pair) & (a >= 0) & (b >= 0), self.pair_ranks[where] * width + at, none)

    def learn(self, pieces: list[str]) -> None:
        """Merges pieces that aren't remembered, those of up to 64 bytes together by size."""
        raw = [x.encode("utf-8", "replace") for x in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for low, width in ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            for lo in range(0, len(some), 16384):
                part = some[lo : lo + 16384].tolist()
                self.kept.update(zip((pieces[i] for i in part), self.merge_many([raw[i] for i in part], width)))
        whole = [i for i in range(len(raw)) if sizes[i] > 64 or raw[i] in self.ranks]
        for i in whole:
            self.kept[pieces[i]] = np.array(self.merge(raw[i]), dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        pieces = list(map(self.find, texts))
        new = set().union(*pieces).difference(self.kept)
        if self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
            new = set().union(*pieces)
        self.kept_bytes += PIECE_BYTES * len(new) + 4 * sum(map(len, new))
        self.learn(list(new))
        get = self.kept.__getitem__
        return [b"".join(map(get, x)) for x in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    return Vocabulary(raw, pattern)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encodes every whole text piece by piece, without special tokens, and decodes the ids again.

    Returns ``doc_id, n_tokens`` and ``ids array<int>, decoded string``, or with ``digests`` ``ids_sha256`` (of ids as
    little-endian 32-bit integers) and ``decoded_sha256`` instead. Map only: no shuffle; each worker keeps a bounded
    memory of pieces it has merged. A null or empty text has no ids; repeated rows, null ids and an empty table are
    encoded row by row. Extra columns aren't read.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value, pattern)
        for batch in batches:
            for lo, hi, _ in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                ids = words.encode([t or "" for t in part.column(1).to_pylist()])
                back = map(words.decode, ids)
                if digests:
                    a = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    b = pa.array([hashlib.sha256(x).hexdigest() for x in back])
                else:
                    sizes = np.cumsum([0, *(len(x) // 4 for x in ids)])
                    values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                    a = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
                    b = pa.array([x.decode("utf-8", "replace") for x in back])
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, a, b], ["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    schema = f"doc_id {kind}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
