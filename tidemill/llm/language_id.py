"""Operator 4: language identification by unigram piece models that sum over all segmentations."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bytewords
from tidemill.llm.bytewords import Texts, text_slices
from tidemill.llm.common import bounded_batches, checked, read, saved

#: The model is fitted on about this many documents of each language, by a hash of their ids.
MAX_DOCS = 500
#: Languages in one broadcast model (some 10 MB). More languages take more passes, one after the other in the same tasks.
LANGUAGES_A_PASS = 64
#: Bytes of words and their scores that a worker remembers, and of sums that it holds at once.
MEMORY_BYTES, SUM_BYTES = 16 << 20, 16 << 20
#: Words of more bytes, as in scripts without blanks, are summed in stretches of STRETCH bytes, TOGETHER at a time; for
#: learning they are cut, between characters, into words of that size.
LONG, STRETCH, TOGETHER = 1024, 64, 256
UNKNOWN = "und"
#: Bytes of words: letters of ASCII and all bytes of other characters.
LETTERS = bytewords.ALNUM.copy()
LETTERS[0x30:0x3A] = False


@dataclass
class Model:
    """Languages, and by sorted hash of a piece its probability in each of them."""

    languages: list[str]
    hashes: np.ndarray
    sizes: np.ndarray  # of the pieces in bytes
    probs: np.ndarray  # one row a piece, one column a language


def pieces_of(rank_file: str) -> list[bytes]:
    """The pieces of a public byte-level vocabulary: no white space but one leading blank, which starts a word."""
    with open(rank_file, "rb") as f:
        tokens = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    lowered = {bytes(bytewords.LOWER[np.frombuffer(t, np.uint8)]) for t in tokens}
    word = lambda t: all(LETTERS[b] for b in t.removeprefix(b" "))
    return sorted({t for t in lowered if word(t)} | {bytes([i]) for i in range(256) if LETTERS[i]} | {b" "})


def piece_hashes(pieces: list[bytes]) -> np.ndarray:
    cuts = np.cumsum([0, *map(len, pieces)])
    return Texts(np.frombuffer(b"".join(pieces), np.uint8), cuts).hashes(cuts[:-1], cuts[1:])


class Lattice:
    """All pieces that match inside words: for each end position and size, the piece's number (or the zero row's).

    Words are given as one buffer; ``cuts`` bounds them. Words are held from the longest to the shortest, so that those
    still running at a position are the first ones.
    """

    def __init__(self, buf: np.ndarray, cuts: np.ndarray, hashes: np.ndarray, piece_sizes: np.ndarray):
        sizes = np.diff(cuts)
        self.piece_sizes = np.unique(piece_sizes).tolist()
        self.longest = self.piece_sizes[-1] if self.piece_sizes else 0
        self.order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = cuts[:-1][self.order], sizes[self.order]
        self.texts, self.hashes = Texts(buf, np.array([0, len(buf)])), hashes
        self.may = np.zeros(1 << 21, dtype=bool)
        self.may[(hashes >> np.uint64(43)).astype(np.int64)] = True

    def running(self, at: int) -> int:
        return int(np.searchsorted(-self.sizes, -at, side="right"))

    def matching(self, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``ends`` are ends of a piece of ``size`` bytes, and of which piece."""
        h = self.texts.hashes(ends - size, ends)
        near = np.flatnonzero(self.may[(h >> np.uint64(43)).astype(np.int64)])
        where = np.searchsorted(self.hashes, h[near]).clip(max=len(self.hashes) - 1)
        good = self.hashes[where] == h[near]
        return near[good], where[good]

    def ending(self, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, words, pieces) of the pieces that end after ``at`` bytes of the words that are as long."""
        ends = self.starts[: self.running(at)] + at
        for size in self.piece_sizes:
            if size > at:
                break
            yield size, *self.matching(ends, size)

    def stretched(self, begins: np.ndarray, steps: int, last: list[np.ndarray], probs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The sums at the last positions after ``steps`` bytes from each of ``begins``, from those before (``last``,
        arrays of stretch, model, case; as many as the longest piece has bytes), and the logs that they were scaled by."""
        scale = np.zeros((len(begins), probs.shape[1]))
        for at in range(1, steps + 1):
            now = np.zeros_like(last[-1])
            for size in self.piece_sizes:
                ends = begins + at
                lo = int(np.searchsorted(ends, size))  # a piece doesn't begin before the word
                words, pieces = self.matching(ends[lo:], size)
                now[lo + words] += last[-size][lo + words] * probs[pieces][:, :, None]
            last = [*last[1:], now]
            if at % 16 == 0 or at == steps:
                top = np.maximum(np.max([x.max(axis=2) for x in last], axis=0), 1e-290)
                last = [x / top[:, :, None] for x in last]
                scale += np.log(top)
        return last, scale

    def forward_long(self, probs: np.ndarray) -> np.ndarray:
        """The log probability of one long word in each model. The sums at the end of a stretch are linear in those
        before it, so all stretches are summed side by side, from each of the positions before as a case of its own, and
        the matrices that this gives are then applied in turn: time goes with the length, and the steps are few."""
        n, k, width = int(self.sizes[0]), probs.shape[1], self.longest
        state, logs = np.zeros((k, width)), np.zeros(k)  # the sums at the last positions, the latest first
        state[:, 0] = 1.0
        begins = self.starts[0] + np.arange(n // STRETCH) * STRETCH
        for lo in range(0, len(begins), TOGETHER):
            some = begins[lo : lo + TOGETHER]
            cases = []
            for d in reversed(range(width)):
                x = np.zeros((len(some), k, width))
                x[:, :, d] = 1.0
                cases.append(x)
            after, scale = self.stretched(some, STRETCH, cases, probs)
            moves = np.stack(after[::-1], axis=2)  # stretch, model, position after, position before
            for i in range(len(some)):
                state = np.einsum("kij,kj->ki", moves[i], state)
                top = np.maximum(state.max(axis=1), 1e-290)
                state, logs = state / top[:, None], logs + np.log(top) + scale[i]
        rest = n % STRETCH
        if rest:
            last = [state[None, :, d, None] for d in reversed(range(width))]
            last, scale = self.stretched(self.starts[:1] + n - rest, rest, last, probs)
            return logs + scale[0] + np.log(np.maximum(last[-1][0, :, 0], 1e-300))
        return logs + np.log(np.maximum(state[:, 0], 1e-300))

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """The log probability of each word, in the given order, in each model (column of ``probs``)."""
        n, k = len(self.sizes), probs.shape[1]
        out, scale = np.zeros((n, k)), np.zeros((n, 1))
        last = [np.ones((n, k))]  # the sums up to as many positions as the longest piece has, the latest at the end
        for at in range(1, int(self.sizes[0]) + 1 if n else 0):
            m = self.running(at)
            now = np.zeros((m, k))
            for size, words, pieces in self.ending(at):
                now[words] += last[-size][words] * probs[pieces]
            last = [*last[len(last) + 1 - self.longest :], now] if len(last) >= self.longest else [*last, now]
            if at % 24 == 0:  # keep the sums of long words from vanishing
                top = np.maximum(np.max([x[:m].max(axis=1) for x in last], axis=0), 1e-290)[:, None]
                last = [x[:m] / top for x in last]
                scale[:m] += np.log(top)
            done = np.arange(self.running(at + 1), m)
            out[done] = np.log(np.maximum(last[-1][done], 1e-300)) + scale[done]
        back = np.empty_like(out)
        back[self.order] = out
        return back


def expected_counts(lattice: Lattice, weight: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, words weighed by their counts: one step of EM.

    Forward and backward sums per word, in units of the word's mean probability a byte, so that words of any length
    neither vanish nor overflow.
    """
    n, longest = len(lattice.sizes), int(lattice.sizes[0])
    logs = lattice.forward(probs[:, None])[lattice.order, 0]
    unit = np.exp(-logs / lattice.sizes)
    fore, aft = np.zeros((longest + 1, n)), np.zeros((longest + 1, n))
    fore[0] = 1.0
    arcs = []
    for at in range(1, longest + 1):
        for size, words, pieces in lattice.ending(at):
            arcs.append((at, size, words, pieces))
            fore[at, words] += fore[at - size, words] * probs[pieces] * unit[words] ** size
    total = fore[lattice.sizes, np.arange(n)]
    aft[lattice.sizes, np.arange(n)] = 1.0
    counts = np.zeros(len(probs))
    share = np.where(total > 0, weight[lattice.order] / np.maximum(total, 1e-300), 0.0)
    for at, size, words, pieces in reversed(arcs):
        p = probs[pieces] * unit[words] ** size
        counts += np.bincount(pieces, fore[at - size, words] * p * aft[at, words] * share[words], minlength=len(probs))
        aft[at - size, words] += aft[at, words] * p
    return counts


def _marked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a buffer, each with a leading blank, as (buffer, cuts)."""
    sizes = ends - starts + 1
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(cuts[-1]), 32, dtype=np.uint8)
    inside = np.arange(len(out)) - np.repeat(cuts[:-1], sizes)
    letters = inside > 0
    out[letters] = buf[(np.repeat(starts - 1, sizes) + inside)[letters]]
    return out, cuts


def _slices(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Words (by size, those of like size together) in groups of which count times longest is about ``cells`` at most."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        n = np.arange(1, len(order) - lo + 1) * sizes[order[lo:]]
        hi = lo + max(1, int(np.searchsorted(n, cells, side="right")))
        yield order[lo:hi]
        lo = hi


def _gather(buf: np.ndarray, cuts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(cuts)[some]
    to = np.concatenate([[0], np.cumsum(sizes)])
    return buf[np.repeat(cuts[some] - to[:-1], sizes) + np.arange(int(to[-1]))], to


def fit_one(words: list[bytes], weight: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """EM over one language's word counts for the probabilities of the pieces; every piece keeps a little."""
    marked = [b" " + w for w in words]
    cuts = np.cumsum([0, *map(len, marked)])
    buf = np.frombuffer(b"".join(marked), np.uint8)
    parts = [(Lattice(*_gather(buf, cuts, some), hashes, sizes), weight[some]) for some in _slices(np.diff(cuts), SUM_BYTES // 16)]
    p = 1.0 / np.power(20.0, sizes)
    p /= p.sum()
    for _ in range(rounds if words else 0):
        p = sum(expected_counts(lattice, w, p) for lattice, w in parts) + smooth
        p /= p.sum()
    return p


def _cut(word: bytes) -> Iterator[bytes]:
    """A long word in parts of LONG bytes at most, cut between characters."""
    lo = 0
    while len(word) - lo > LONG:
        hi = lo + LONG
        while hi > lo + LONG - 4 and word[hi] & 0xC0 == 0x80:
            hi -= 1
        yield word[lo:hi]
        lo = hi
    yield word[lo:]


def word_counts(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(lang, word, n) of the bounded sample of training documents, counted by a partial aggregation."""
    may = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    may = may.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    sizes = may.groupBy(F.col("lang").alias("_lang")).agg((MAX_DOCS / F.count("*")).alias("_share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_003)) / 1_000_003
    drawn = may.select(F.col("lang").cast("string").alias("lang"), "text", draw.alias("_draw"))
    sample = drawn.join(checked(sizes), F.col("lang") == F.col("_lang")).where("_draw < _share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                starts, ends, first = texts.spans(LETTERS)
                hashes = texts.hashes(starts, ends)
                for i in range(hi - lo):
                    a = int(first[i])
                    _, at, n = np.unique(hashes[a : first[i + 1]], return_index=True, return_counts=True)
                    raw = [texts.buf[starts[a + j] : ends[a + j]].tobytes() for j in at.tolist()]
                    if any(len(w) > LONG for w in raw):
                        parts = [(part, m) for w, m in zip(raw, n.tolist(), strict=True) for part in _cut(w)]
                        raw, n = [w for w, _ in parts], np.array([m for _, m in parts])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[lo + i]] * len(raw), pa.string()), pa.array(raw, pa.binary()), pa.array(n, pa.int64())],
                        ["lang", "word", "n"],
                    )

    found = bounded_batches(sample).mapInArrow(count, "lang string, word binary, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, rank_file: str, folds: int = 4, held_out: int = 2) -> list[Model]:
    """The models of all languages, LANGUAGES_A_PASS in each, sorted by name. Executors fit them, a language in a task,
    on the words of its sampled documents."""
    pieces = pieces_of(rank_file)
    hashes = piece_hashes(pieces)
    order = np.argsort(hashes)
    hashes, sizes = hashes[order], np.array([len(p) for p in pieces])[order]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((hashes, sizes))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        p = fit_one(group.column("word").to_pylist(), group.column("n").to_numpy().astype(float), *shared.value)
        return pa.table({"lang": group.column("lang")[:1], "probs": pa.array([p.astype("<f4").tobytes()], pa.binary())})

    fitted = saved(word_counts(docs, folds, held_out).groupBy("lang").applyInArrow(learn, "lang string, probs binary"))
    names = sorted(r["lang"] for r in fitted.select("lang").collect())
    models = []
    for lo in range(0, len(names), LANGUAGES_A_PASS):
        some = names[lo : lo + LANGUAGES_A_PASS]
        rows = {r["lang"]: r["probs"] for r in fitted.where(F.col("lang").isin(some)).collect()}  # LANGUAGES_A_PASS rows
        models.append(Model(some, hashes, sizes, np.stack([np.frombuffer(rows[x], "<f4") for x in some], axis=1)))
    return models


class Memory:
    """Scores of words that a worker has met, by their hashes; bounded by bytes and emptied when it is full."""

    def __init__(self, model: Model):
        self.model, k = model, len(model.languages)
        self.most = MEMORY_BYTES // (8 + 8 * k)
        self.hashes, self.logs = np.empty(0, np.uint64), np.empty((0, k))

    def scores(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log probability of every word in each language; those that aren't remembered are found together."""
        hashes, at, which = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, hashes)
        old = np.zeros(len(hashes), bool)
        inside = where < len(self.hashes)
        old[inside] = self.hashes[where[inside]] == hashes[inside]
        logs = np.empty((len(hashes), len(self.model.languages)))
        logs[old] = self.logs[where[old]]
        new = np.flatnonzero(~old)
        if len(new):
            buf, cuts = _marked(texts.buf, starts[at[new]], ends[at[new]])
            width = int(self.model.sizes.max())
            n = max(1, SUM_BYTES // (8 * len(self.model.languages) * width))
            order = np.argsort(np.diff(cuts), kind="stable")
            short = int(np.searchsorted(np.diff(cuts)[order], LONG, side="right"))
            for i in order[short:].tolist():
                logs[new[i]] = Lattice(buf[cuts[i] : cuts[i + 1]], cuts[i : i + 2] - cuts[i], self.model.hashes, self.model.sizes).forward_long(self.model.probs)
            order = order[:short]
            for lo in range(0, len(order), n):
                some = order[lo : lo + n]
                logs[new[some]] = Lattice(*_gather(buf, cuts, some), self.model.hashes, self.model.sizes).forward(self.model.probs)
            if len(self.hashes) + len(new) > self.most:
                self.hashes, self.logs = self.hashes[:0], self.logs[:0]
                where = np.zeros(len(hashes), np.int64)
            if len(new) <= self.most:
                self.hashes, self.logs = np.insert(self.hashes, where[new], hashes[new]), np.insert(self.logs, where[new], logs[new], axis=0)
        return logs[which]


def identify(docs: DataFrame, models: list[Model]) -> DataFrame:
    """The language of every whole text: ``doc_id, lang_pred, score`` (its share of the likelihoods).

    A text's likelihood is the product of its words'; a word's is the sum over all segmentations into pieces. Words are
    lower-cased in A-Z and cut at ASCII characters other than letters; a worker remembers the scores of words. Map only:
    each model's languages are compared in a pass of its own, which hands on the best one so far.

    A text without a letter, a null text, and any text if nothing was learned, is ``und`` with score 0. Of equally
    likely languages the first by name wins. Repeated rows, null ids and an empty table are judged row by row. Extra
    columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ascii_letter = LETTERS.copy()
    ascii_letter[0x80:] = False
    state = ["doc_id", "text", "lang_pred", "top", "total"]

    def run(batches: Iterator[pa.RecordBatch], shared: Broadcast | None, last: bool) -> Iterator[pa.RecordBatch]:
        model = shared.value if shared else None
        if model and not hasattr(model, "memory"):
            model.memory = Memory(model)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                n = hi - lo
                best = batch.column(2).slice(lo, n).to_numpy(zero_copy_only=False).copy()
                top, total = (batch.column(i).slice(lo, n).to_numpy(zero_copy_only=False).copy() for i in (3, 4))
                starts, ends, first = texts.spans(LETTERS)
                if model and len(starts):
                    logs = model.memory.scores(texts, starts, ends)
                    sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
                    mine = sums[first[1:]] - sums[first[:-1]]
                    high = mine.max(axis=1)
                    best = np.where(high > top, np.array(model.languages, dtype=object)[mine.argmax(axis=1)], best)
                    both = np.maximum(top, high)
                    total = total * np.exp(top - both) + np.exp(mine - both[:, None]).sum(axis=1)
                    top = both
                if last:
                    score = np.where(total > 0, 1.0 / np.maximum(total, 1e-300), 0.0)
                    # words of other characters than ASCII may have no letter at all
                    plain = np.concatenate([[0], np.cumsum(ascii_letter[texts.buf])])[texts.offsets]
                    for i in np.flatnonzero(np.diff(plain) == 0).tolist():
                        text = texts.text(int(texts.offsets[i]), int(texts.offsets[i + 1]))
                        if not any(c.isalpha() for c in text):
                            best[i], score[i] = UNKNOWN, 0.0
                    columns = [batch.column(0).slice(lo, n), pa.array(best, pa.string()), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])
                else:
                    columns = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(best, pa.string()), pa.array(top), pa.array(total)]
                    yield pa.RecordBatch.from_arrays(columns, state)

    lowest = F.lit(-1e300).alias("top")
    out = bounded_batches(docs).select("doc_id", "text", F.lit(UNKNOWN).alias("lang_pred"), lowest, F.lit(0.0).alias("total"))
    passes = [docs.sparkSession.sparkContext.broadcast(m) for m in models] or [None]
    for k, shared in enumerate(passes):
        last = k == len(passes) - 1
        schema = f"doc_id {kind}, lang_pred string, score double" if last else f"doc_id {kind}, text string, lang_pred string, top double, total double"
        out = out.mapInArrow(lambda b, s=shared, e=last: run(b, s, e), schema)
    return out


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
