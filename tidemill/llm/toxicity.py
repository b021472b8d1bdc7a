"""Operator 3: toxicity by multiple-instance learning; sentences are scored, documents are labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bytewords import ALNUM, Texts, text_slices
from tidemill.llm.common import bounded_batches, read, saved

#: Labelled documents of each class that the model may be fitted on. Which they are follows from a hash of their ids.
MAX_TOXIC, MAX_OTHER = 1500, 2500
#: Features that take part at most, in how many documents they are at least, and their least excess in standard errors.
MAX_FEATURES, MIN_DOCS, MIN_GAIN = 3000, 4, 4.0
#: Bytes that end a sentence.
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".!?\n"]] = True
#: A word's features: the word and, if it is longer, its first bytes, so that endings don't hide a stem.
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    """Feature weights by sorted feature hash, and the weight that every sentence has."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends, each word's sentence (numbered through all texts), each sentence's text."""
    starts, ends, first = texts.spans(ALNUM)
    stop = np.cumsum(STOPS[texts.buf])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    change = np.ones(len(starts), dtype=bool)
    if len(starts) > 1:
        change[1:] = (stop[starts[1:]] != stop[starts[:-1]]) | (doc[1:] != doc[:-1])
    return starts, ends, np.cumsum(change) - 1, doc[change]


def _features(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their feature hashes), one kind of feature after another."""
    yield np.arange(len(starts)), texts.hashes(starts, ends)
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        yield longer, texts.hashes(starts[longer], starts[longer] + n) ^ np.uint64(0x5851F42D4C957F2D * n % (1 << 64))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def chosen_features(rows: DataFrame) -> np.ndarray:
    """The hashes of the MAX_FEATURES features with the largest excess in toxic documents, counted over the sample
    (``text``, ``toxic``) by a grouped aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, texts in text_slices(batch, "text", lower=True):
                starts, ends, sentence, doc = _sentences(texts)
                for which, hashes in _features(texts, starts, ends):
                    row = doc[sentence[which]] if len(which) else np.empty(0, np.int64)
                    order = np.lexsort((hashes, row))
                    row, hashes = row[order], hashes[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(toxic[lo + row[new]].astype(np.int64))], ["feature", "toxic"])

    sizes = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).first()
    n, y = sizes["n"], sizes["y"] or 0
    if not 0 < y < n:
        return np.empty(0, np.uint64)
    counts = bounded_batches(rows).select("text", "toxic").mapInArrow(run, "feature long, toxic long")
    counts = counts.groupBy("feature").agg(F.count("*").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") >= MIN_DOCS)
    share = F.col("c") / n
    gain = (F.col("t") / y - (F.col("c") - F.col("t")) / (n - y)) / F.sqrt(share * (1 - share) * (1 / y + 1 / (n - y)) + 1e-12)
    best = counts.withColumn("gain", gain).where(F.col("gain") > MIN_GAIN).orderBy(F.desc("gain"), "feature").limit(MAX_FEATURES)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], dtype=np.int64).view(np.uint64))


def bags(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """Of each sampled text its ``toxic`` label, ``plain`` (sentences without a chosen feature), and the others as
    ``sentence`` numbers and ``feature`` numbers: what the fit needs, without the texts."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                starts, ends, sentence, doc = _sentences(texts)
                pairs = np.unique(_known(texts, starts, ends, sentence, words))
                s_of, w_of = pairs // len(words), pairs % len(words)
                cuts = np.searchsorted(doc[s_of], np.arange(hi - lo + 1)).astype(np.int32)
                full = np.bincount(doc[np.unique(s_of)], minlength=hi - lo)
                plain = np.bincount(doc, minlength=hi - lo) - full
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (s_of, w_of)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(plain), *lists], ["doc_id", "toxic", "plain", "sentence", "feature"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return bounded_batches(rows).select("doc_id", "text", "toxic").mapInArrow(run, f"doc_id {kind}, toxic int, plain long, sentence array<long>, feature array<long>")


def fit(toxic: np.ndarray, plain: np.ndarray, sentences: list[np.ndarray], features: list[np.ndarray], words: np.ndarray, steps: int = 200, rate: float = 0.15, penalty: float = 1e-5) -> Model:
    """Gradient steps (Adam) on the documents' log loss, where a document is clean if all its sentences are:
    ``P = 1 - prod(1 - p_s)`` with ``p_s`` logistic in the features of the sentence's words. Sentences without a chosen
    feature differ in nothing, so a document has a number of them."""
    y, n_d = toxic.astype(float), len(toxic)
    if not len(words):
        return Model(words, np.empty(0), -12.0)
    in_doc = np.repeat(np.arange(n_d), [len(x) for x in sentences])
    _, first, s_of = np.unique(np.stack([in_doc, np.concatenate(sentences)]), axis=1, return_index=True, return_inverse=True)
    doc, w_of = in_doc[first], np.concatenate(features)
    # clean documents outnumber toxic ones in the corpus; the sample is weighed back to even odds
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(len(words)), -5.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(s_of, w[w_of], minlength=len(doc))
        total = np.bincount(doc, _softplus(z), minlength=n_d) + plain * _softplus(b)
        slope = np.where(y > 0, -1.0 / np.expm1(np.maximum(total, 1e-9)), 1.0) * weight
        dz = slope[doc] / (1.0 + np.exp(-z))
        g = np.concatenate([np.bincount(w_of, dz[s_of], minlength=len(words)) + penalty * w, [dz.sum() + (slope * plain).sum() / (1.0 + np.exp(-b))]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    big = np.abs(w) > 0.02
    return Model(words[big], w[big], float(b))


def _known(texts: Texts, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray, words: np.ndarray) -> np.ndarray:
    """sentence * features + feature for every known feature of every word."""
    may = np.zeros(1 << 16, dtype=bool)
    may[(words >> np.uint64(48)).astype(np.int64)] = True
    found = [np.empty(0, np.int64)]
    for which, hashes in _features(texts, starts, ends):
        near = np.flatnonzero(may[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(words, hashes[near]).clip(max=len(words) - 1)
        good = words[at] == hashes[near]
        found.append(sentence[which[near[good]]].astype(np.int64) * len(words) + at[good])
    return np.concatenate(found)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(``doc_id, text, toxic``) of the bounded sample: labelled documents outside fold 0, the first by a hash of the id.
    An id that is labelled both ways is toxic; of an id with several texts the least is taken."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    known = known.agg(F.max("toxic").cast("int").alias("_toxic")).where(F.crc32(F.col("_id").cast("string")) % folds != 0)
    known = saved(known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi"))
    order = [F.xxhash64("_id", F.lit(3)), F.col("_id")]
    some = known.where("_toxic = 1").orderBy(*order).limit(MAX_TOXIC)
    some = saved(some.unionByName(known.where("_toxic = 0").orderBy(*order).limit(MAX_OTHER)))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # at most MAX_TOXIC + MAX_OTHER ids
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.max("_toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """The model of the bounded sample. Texts stay on the executors; the driver gets a row a document with the numbers
    of the chosen features in it."""
    rows = saved(training_rows(docs, labels, folds))
    words = chosen_features(rows)
    if not len(words):
        row = rows.agg(F.min("toxic").alias("least"), F.max(F.length("text")).alias("longest")).first()
        return Model(words, np.empty(0), 0.0 if row["least"] == 1 and row["longest"] else -12.0)
    found = sorted(bags(rows, words).collect(), key=lambda r: str(r["doc_id"]))
    lists = [[np.array(r[c], dtype=np.int64) for r in found] for c in ("sentence", "feature")]
    return fit(np.array([r["toxic"] for r in found]), np.array([float(r["plain"]) for r in found]), *lists, words)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Scores every whole text: ``doc_id, score, sentences`` (text and score of each sentence of at least ``least``).

    A document's score is the noisy-or of its sentences' scores. Sentences end at ``. ! ?`` and line breaks and are
    bags of lower-cased words and their stems. Map only, with a small broadcast model.

    A text without words, and a null text, scores 0; repeated rows, null ids and an empty table are scored row by row.
    Without labels of both classes nothing is learned and scores are near 0, or one half if all labels are toxic. Extra
    columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            originals = batch.column(1)
            for lo, hi, texts in text_slices(batch, "text", lower=True):
                starts, ends, sentence, doc = _sentences(texts)
                z = np.full(len(doc), model.bias)
                if len(model.hashes):
                    pairs = np.unique(_known(texts, starts, ends, sentence, model.hashes))
                    z += np.bincount(pairs // len(model.hashes), model.weights[pairs % len(model.hashes)], minlength=len(doc))
                total = np.bincount(doc, _softplus(z), minlength=hi - lo)
                p = 1.0 / (1.0 + np.exp(-z))
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                bad = np.flatnonzero(p >= least)
                begin, end = np.searchsorted(sentence, bad), np.searchsorted(sentence, bad, side="right") - 1
                for s, a, b in zip(bad.tolist(), begin.tolist(), end.tolist(), strict=True):
                    d = int(doc[s])
                    base = int(texts.offsets[d])
                    raw = originals[lo + d].as_py().encode()[int(starts[a]) - base : int(ends[b]) - base]
                    spans[d].append({"sentence": raw.decode("utf-8", "replace"), "score": float(p[s])})
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(-np.expm1(-total)), pa.array(spans, found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "sentences"])

    schema = f"doc_id {kind}, score double, sentences array<struct<sentence:string,score:double>>"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("sentences.sentence").alias("sentences"),
    )


QUERIES = {"op3_toxicity": op3_toxicity}
