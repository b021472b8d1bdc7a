"""Operator 6: a quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_IDS, keep_ids, read, saved
from tidemill.llm.quality_features import CLASSES
from tidemill.llm.quality_rules import BASE, MORE, _matrix, count

#: Labelled documents of each class that the classifier is fitted on at most, the first by a hash of their ids.
MAX_LABELLED = 5000
#: Rates this near 0 or 1 are as good as these; without it their log odds aren't finite.
LEAST_RATE = 1e-9


def _inputs(counts: list[np.ndarray], chars: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the classifier sees of each text: shares, densities and sizes, no ids, languages or sources."""
    n_words, word_chars, _, dup_lines, repeats, n_chars, n_lines = (c.astype(float) for c in counts)
    shares = chars / np.maximum(n_chars, 1)[:, None]
    common = 1 - words[:, -1] / np.maximum(words.sum(axis=1), 1)
    upper = shares[:, CLASSES.index("upper")] / np.maximum(shares[:, CLASSES.index("lower")] + shares[:, CLASSES.index("upper")], 1e-6)
    return np.column_stack(
        [
            shares,
            np.sqrt(shares),
            np.minimum(upper, 1),
            repeats / np.maximum(n_words, 1),
            dup_lines / np.maximum(n_lines, 1),
            common,
            np.minimum(word_chars / np.maximum(n_words, 1), 20) / 10,
            np.log1p(n_words) / 10,
            np.exp(-n_words / 5),
        ]
    )


class Logistic:
    """A logistic regression on standardised inputs, fitted by Newton steps with a ridge."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        hold = np.full(z.shape[1], ridge)
        hold[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(hold)
            w = w - np.linalg.solve(h, z.T @ (p - y) + hold * w)
        self.w = w
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


def _batch_inputs(batch: pa.RecordBatch, at: int) -> np.ndarray:
    counts = [batch.column(at + i).to_numpy() for i in range(len(BASE) + len(MORE))]
    return _inputs(counts, _matrix(batch.column(at + len(counts))), _matrix(batch.column(at + len(counts) + 1)))


def train(counted: DataFrame, labels: DataFrame) -> tuple[Logistic | None, float]:
    """The classifier and the share of good documents over all labelled rows: its intercept is shifted from the sample's
    log odds to those, since the bound on a class changes the mix."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good")).distinct()
    order = [F.xxhash64("_id", F.lit(6)), F.col("_id")]
    some = known.where("_good = 0").orderBy(*order).limit(MAX_LABELLED)
    some = saved(some.unionByName(known.where("_good = 1").orderBy(*order).limit(MAX_LABELLED)))
    rows = counted.join(F.broadcast(some), counted["doc_id"] == some["_id"])  # at most 2 * MAX_LABELLED rows
    table = rows.select("_good", *BASE, *MORE, "chars", "words").toArrow().combine_chunks()
    y = table.column(0).to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None, 0.5
    x = _batch_inputs(table.to_batches()[0], 1)
    order = np.lexsort([*x.T, y])  # the same sums in any order of the rows
    model = Logistic().fit(x[order], y[order])
    n = dict(counted.select(F.col("doc_id").alias("_id")).join(known, "_id").groupBy("_good").count().collect())  # two rows
    rate, sampled = (float(np.clip(share, 0.01, 0.99)) for share in (n[1] / (n[0] + n[1]), y.mean()))
    model.w[-1] += np.log(rate / (1 - rate)) - np.log(sampled / (1 - sampled))
    return model, rate


@dataclass
class Priors:
    """Of the corpus: documents, sum of their probabilities, and the pseudo-counts by which a host's rate is shrunk to
    the global one and a path's to its host's; none (infinite) where groups differ by no more than chance."""

    n: float
    total: float
    host: float
    path: float


def priors(paths: DataFrame) -> Priors:
    """Moments of a nested layout (``_host, _path, _n`` rows, ``_s`` sum and ``_q`` sum of squares of probabilities).

    The variance within paths is that of chance. What paths of a host vary by about their host's own mean beyond that is
    the variance between paths; what hosts vary by about the global mean beyond both is the one between hosts. A
    pseudo-count is the variance of chance over that between groups.
    """
    n, s = F.col("_n"), F.col("_s")
    hosts = paths.groupBy("_host").agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col("_q")).alias("q"), F.sum(n * n).alias("nn"), F.sum(s * s / n).alias("ss"), F.count("*").alias("k"))
    n, s = F.col("n"), F.col("s")
    row = hosts.agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("q").alias("q"), F.sum("ss").alias("paths"), F.sum(s * s / n).alias("hosts"),
        F.sum("k").alias("k"), F.count("*").alias("h"), F.sum("nn").alias("nn"), F.sum(F.col("nn") / n).alias("inner"), F.sum(n * n).alias("outer"),
    ).first()
    if not row["n"]:
        return Priors(0.0, 0.0, np.inf, np.inf)
    n, rate = float(row["n"]), row["s"] / row["n"]
    chance = (row["q"] - row["paths"]) / (n - row["k"]) if n > row["k"] else rate * (1 - rate)
    room = n - row["inner"]
    between = max(0.0, (row["paths"] - row["hosts"] - (row["k"] - row["h"]) * chance) / room) if room > 0 else 0.0
    room = n - row["outer"] / n
    over = row["hosts"] - row["s"] ** 2 / n - (row["h"] - 1) * chance - between * (row["inner"] - row["nn"] / n)
    apart = max(0.0, over / room) if room > 0 else 0.0
    strength = lambda v: float(max(0.0, chance) / v) if v > 1e-12 else np.inf
    return Priors(n, float(row["s"]), strength(apart), strength(between))


def _shrunk(total: Column, n: Column, parent: Column, strength: float) -> Column:
    """The posterior mean of a group's rate without the document itself (``total`` and ``n`` are without it)."""
    if np.isinf(strength):
        return parent
    return F.when(n + strength > 0, (total + strength * parent) / (n + strength)).otherwise(parent)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - LEAST_RATE)), F.lit(LEAST_RATE))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Quality of every whole text: ``doc_id, evidence, host_rate, path_rate, score, kept``.

    The evidence is the log likelihood ratio of a classifier on the text's counts, fitted on a bounded sample of
    labelled rows. Its probabilities over all documents are summed by host, and by path within host. Each path's rate is
    shrunk to its host's, hosts' rates to the global one, the more the fewer documents there are (``priors``). A
    document's own probability is left out of all of them, so it isn't counted twice. ``score`` joins the evidence with
    the path's rate; documents under 0.5 aren't ``kept``.

    Sums are pre-aggregated before the shuffle, so a host with a third of all rows is no burden; the sums are
    broadcast if they are few, else joined by a shuffle.

    Null hosts or paths are groups of their own. A null text is an empty one. Without labels of both classes every
    score is 0.5 and all are kept; 0.5 itself is kept. A document alone in its path has the host's rate, one alone in its
    host the global one, one alone in the table that of the labels. Repeated rows and null ids are judged row by row; an
    empty table gives an empty result; extra columns aren't read.
    """
    columns = ["doc_id", host, path]
    counted = saved(count(docs.select("doc_id", "text", host, path), columns))
    model, known_rate = train(counted, labels)
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(["doc_id", "_host", "_path"], columns))
    prior = float(np.log(known_rate / (1 - known_rate)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            odds = model.log_odds(_batch_inputs(batch, 3)) if model else np.full(batch.num_rows, prior)
            values = [pa.array(odds - prior), pa.array(1 / (1 + np.exp(-odds)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *values], ["doc_id", "_host", "_path", "evidence", "_p"])

    weighed = counted.mapInArrow(weigh, f"{kinds}, evidence double, _p double")
    p = F.col("_p")
    paths = saved(weighed.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum(p).alias("_s"), F.sum(p * p).alias("_q")))
    known = priors(paths)
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    sums = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h")))
    sums = saved(sums.select(F.col("_host").alias("_a"), F.col("_path").alias("_b"), "_n", "_s", "_hn", "_hs"))
    if sums.count() <= BROADCAST_IDS:
        sums = F.broadcast(sums)
    at_home = F.col("_host").eqNullSafe(F.col("_a")) & F.col("_path").eqNullSafe(F.col("_b"))
    rate = (known.total - p) / (known.n - 1) if known.n > 1 else F.lit(known_rate)
    judged = weighed.join(sums, at_home).withColumn("host_rate", _shrunk(F.col("_hs") - p, F.col("_hn") - 1, rate, known.host))
    judged = judged.withColumn("path_rate", _shrunk(F.col("_s") - p, F.col("_n") - 1, F.col("host_rate"), known.path))
    odds = F.col("evidence") + _logit(F.col("path_rate"))
    judged = judged.withColumn("score", 1 / (1 + F.exp(-odds)) if model else F.lit(0.5))
    return judged.select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, with all their columns. An id goes if all its rows are rejected; rows
    without an id stay. An empty table gives an empty one."""
    judged = classify(docs, labels, host, path).where(F.col("doc_id").isNotNull())
    bad = judged.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept")).where(~F.col("_kept"))
    return keep_ids(docs, bad, "left_anti")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
