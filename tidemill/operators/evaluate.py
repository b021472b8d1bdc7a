"""Measures of rankers and predictions: AUC, precision, calibration, drift, intervals, promotion gates.

Curves are computed from counts by distinct score; the running sums over scores are taken in two steps, by score bucket
and within a bucket (``ranking``), so no window runs over all rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.rounding import rounded
from tidemill.operators.ranking import cuts, null_safe, running
from tidemill.sources.folders import saved


def score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives by distinct score; a missing score counts as the lowest."""
    value = F.coalesce(F.col(score), F.lit(-1e308))
    return df.groupBy(*by, value.alias("score")).agg(F.count_if(label).alias("pos"), F.count_if(~F.col(label)).alias("neg"))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the curve of each slice, ties half; null for one class."""
    counts = running(score_counts(df, score, label, by), "score", ["neg"], by)
    out = counts.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).alias("_twice"),
    )
    area = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_twice") / (2 * F.col("positives") * F.col("negatives")))
    return out.select(*by, "positives", "negatives", rounded(area, 6).alias("auc"))


def top_k(df: DataFrame, score: str, label: str, key: str, k: int) -> DataFrame:
    """Winners, precision and lift among the best ``k`` rows, and their discounted gain; one row."""
    best = df.orderBy(F.desc_nulls_last(score), key).limit(k)
    ranked = best.withColumn("_r", F.row_number().over(W.orderBy(F.desc_nulls_last(score), key)))  # k rows
    gain = F.col(label).cast("int") / F.log2(F.col("_r") + 1)
    top = ranked.agg(F.count_if(label).alias("winners"), F.count("*").alias("n"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("_dcg"))
    total = df.agg(F.count("*").alias("_all"), F.count_if(label).alias("_pos"))
    both = top.crossJoin(total)  # one row each
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("_pos").cast("int")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    base = F.col("_pos") / F.col("_all")
    return both.select(
        "winners",
        rounded(F.col("winners") / F.col("n"), 6).alias("precision"),
        rounded(F.when(F.col("_pos") > 0, F.col("winners") / F.col("_pos")), 6).alias("recall"),
        rounded(base, 6).alias("base_rate"),
        rounded(F.when(base > 0, F.col("winners") / F.col("n") / base), 4).alias("lift"),
        rounded(F.when(F.col("_pos") > 0, F.col("_dcg") / ideal), 6).alias("ndcg"),
    )


def pr_auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Average precision: precision at each distinct score, weighed by the recall that it adds."""
    counts = running(score_counts(df, score, label, by), "score", ["pos", "neg"], by, descending=True)
    p = F.col("pos_before") + F.col("pos")
    out = counts.groupBy(*by).agg(F.sum(F.col("pos") * p / (p + F.col("neg_before") + F.col("neg"))).alias("_s"), F.sum("pos").alias("_p"))
    return out.select(*by, rounded(F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")), 6).alias("pr_auc"))


def calibration_bins(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed: rows, mean prediction, rate."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    mean = F.sum(F.col(p).cast("decimal(18,6)")).cast("double") / F.count("*")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), rounded(mean, 6).alias("predicted"), rounded(F.count_if(label) / F.count("*"), 6).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(rounded(F.sum(F.abs(F.col("predicted") - F.col("rate")) * F.col("n")) / F.sum("n"), 6).alias("ece"))


def exact_quantiles(df: DataFrame, column: str, buckets: int) -> list[float]:
    """The quantiles i / buckets of a column, interpolated between neighbours; empty for an empty column."""
    return quantiles_of(df, [column], buckets)[column]


def quantiles_of(df: DataFrame, columns: list[str], buckets: int) -> dict[str, list[float]]:
    """Exact quantiles i / buckets of several columns, from counts by distinct value that one pass takes of all of them;
    nulls don't count. None for an empty column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x")
    counts = saved(df.select(each).select("_x.*").where("v is not null").groupBy("name", "v").agg(F.count("*").alias("n")))
    totals = {r["name"]: r["total"] for r in counts.groupBy("name").agg(F.sum("n").alias("total")).collect()}  # a row a column
    at = {c: [i * (n - 1) / buckets for i in range(buckets + 1)] for c, n in totals.items()}
    if not at:
        return {c: [] for c in columns}
    wanted = {c: sorted({int(x) for x in xs} | {min(int(x) + 1, totals[c] - 1) for x in xs}) for c, xs in at.items()}
    mine = F.create_map(*[x for c, w in wanted.items() for x in (F.lit(c), F.array(*[F.lit(i).cast("long") for i in w]))])[F.col("name")]
    inside = F.filter(mine, lambda i: (i >= F.col("n_before")) & (i < F.col("n_before") + F.col("n")))
    rows = running(counts, "v", ["n"], ["name"]).select("name", "v", F.explode(inside).alias("i"))
    value = {(r["name"], r["i"]): r["v"] for r in rows.collect()}  # two for each quantile at most
    between = lambda c, x: value[c, int(x)] + (x - int(x)) * (value[c, min(int(x) + 1, totals[c] - 1)] - value[c, int(x)])
    return {c: [between(c, x) for x in at.get(c, [])] for c in columns}


def psi(base: DataFrame, actual: DataFrame, columns: list[str], buckets: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability of columns: shares between the baseline's quantile edges; values outside are left out. A
    column without any value in the baseline has no row."""
    edges = {c: sorted(set(e)) for c, e in quantiles_of(base, columns, buckets).items()}
    spark = base.sparkSession
    cells = [(c, i) for c, e in edges.items() for i in range(1, max(len(e) - 1, 1) + 1) if e]

    def histogram(df: DataFrame, alias: str) -> DataFrame:
        pieces = []
        for c, e in edges.items():
            if e:
                v = F.col(c).cast("double")
                passed = sum((F.when(v >= x, 1).otherwise(0) for x in e), F.lit(0))
                at = F.least(passed, F.lit(max(len(e) - 1, 1)))
                pieces.append(F.when(v.between(e[0], e[-1]), F.struct(F.lit(c).alias("name"), at.alias("bin"))))
        rows = df.select(F.explode(F.array_compact(F.array(*pieces))).alias("x")).select("x.*")
        return rows.groupBy("name", "bin").agg(F.count("*").alias(alias))

    frame = spark.createDataFrame(cells, "name string, bin int")
    if not cells:
        return frame.select("name", F.lit(0.0).alias("psi"))
    both = frame.join(histogram(base, "b"), ["name", "bin"], "left").join(histogram(actual, "a"), ["name", "bin"], "left").na.fill(0, ["a", "b"])
    w = W.partitionBy("name")  # a few bins of each column
    e = F.greatest(F.col("b") / F.sum("b").over(w), F.lit(floor))
    o = F.greatest(F.col("a") / F.greatest(F.sum("a").over(w), F.lit(1)), F.lit(floor))
    return both.withColumn("_t", (o - e) * F.log(o / e)).groupBy("name").agg(rounded(F.sum("_t"), 4).alias("psi"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows where a column is missing or zero, one row a column."""
    shares = df.agg(*[rounded(F.avg(F.when(F.col(c).isNull() | (F.col(c) == 0), 1.0).otherwise(0.0)), 4).alias(c) for c in columns])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("share")) for c in columns])).alias("x")).select("x.*")


def regression_quality(df: DataFrame, y: str, q: str, tau: float) -> DataFrame:
    """Pinball loss, share of predictions over the truth, coverage and mean absolute error."""
    d = F.col(y) - F.col(q)
    loss = F.when(d >= 0, tau * d).otherwise((tau - 1) * d)
    mean = lambda c: F.sum(c.cast("decimal(18,6)")).cast("double") / F.count("*")
    return df.agg(
        rounded(mean(loss), 5).alias("pinball"),
        rounded(F.count_if(d < 0) / F.count("*"), 5).alias("over"),
        rounded(F.count_if(d >= 0) / F.count("*"), 5).alias("coverage"),
        rounded(mean(F.abs(d)), 5).alias("mae"),
    )


def lift_at(df: DataFrame, score: str, label: str, by: list[str], share: float = 0.1) -> DataFrame:
    """Precision and lift among the best ``share`` of each slice's rows (``taken``, rounded up); rows that tie with the
    last one taken count with the part of them that is. Counted by distinct score, so no slice is sorted in one task."""
    counts = running(score_counts(df, score, label, by).withColumn("_n", F.col("pos") + F.col("neg")), "score", ["_n"], by, descending=True)
    totals = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(label).alias("_all"))
    totals = totals.withColumn("taken", F.ceil(F.col("n") * F.lit(share).cast("decimal(10,6)")).cast("long"))
    rows = null_safe(counts, totals, by) if by else counts.crossJoin(F.broadcast(totals))  # one row
    part = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("taken") - F.col("_n_before"))) / F.col("_n")
    out = rows.groupBy(*by, "n", "taken", "_all").agg(F.sum(F.col("pos") * part).alias("_wins"))
    precision, base = F.col("_wins") / F.col("taken"), F.col("_all") / F.col("n")
    return out.select(*by, "n", "taken", rounded(precision, 6).alias("precision"), rounded(F.when(base > 0, precision / base), 4).alias("lift"))


# ---- Bootstrap over clusters

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: Parts that the rows of one frequent score are dealt to, and rows whose weights a task holds at a time.
_SALTS, _STRIP = 16, 2_000


def replicate_weights(clusters: np.ndarray, resamples: int) -> np.ndarray:
    """How often each cluster (a 64-bit hash) is drawn in each replicate: Poisson(1) numbers from a hash of both, so the
    same wherever a cluster's rows are."""
    with np.errstate(over="ignore"):
        h = clusters.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


class _Area:
    """Sums of a bucket by replicate, fed with rows in order of score: pairs won (ties half), positives, negatives."""

    def __init__(self, resamples: int):
        self.area, self.pos, self.neg = (np.zeros(resamples) for _ in range(3))
        self.last, self.tied = None, np.zeros((2, resamples))

    def _close(self) -> None:
        self.area += self.tied[0] * (self.neg + self.tied[1] / 2)
        self.pos, self.neg, self.tied = self.pos + self.tied[0], self.neg + self.tied[1], np.zeros_like(self.tied)

    def add(self, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        p, n = np.add.reduceat(w * y[:, None], starts, axis=0), np.add.reduceat(w * ~y[:, None], starts, axis=0)
        if self.last is not None and v[0] != self.last:
            self._close()
        self.tied += np.stack([p[0], n[0]])
        if len(starts) > 1:
            self._close()
            before = self.neg + np.concatenate([np.zeros((1, n.shape[1])), np.cumsum(n[1:-1], axis=0)]) if len(starts) > 2 else None
            if before is not None:
                self.area += (p[1:-1] * (before[:-1] + n[1:-1] / 2)).sum(axis=0)
                self.pos, self.neg = self.pos + p[1:-1].sum(axis=0), self.neg + n[1:-1].sum(axis=0)
            self.tied = np.stack([p[-1], n[-1]])
        self.last = v[-1]

    def row(self) -> tuple[list[float], list[float], list[float]]:
        self._close()
        return self.area.tolist(), self.pos.tolist(), self.neg.tolist()


def bootstrap_aucs(df: DataFrame, scores: list[str], label: str, cluster: str, by: str | None = None, resamples: int = 500) -> DataFrame:
    """(``by``, ``aucs``): for each slice an array for each score with its AUC in every replicate of a bootstrap over
    clusters; null for one class. Rows without a score or label are left out.

    Rows are summed by (slice, cluster, scores, label) and go, by score, to ordered buckets; what is shuffled is these
    rows, whatever the number of replicates. A task draws the weights of the rows as it reads them, in order of score, and
    hands on three sums a replicate; those of the buckets then make the areas. A score on the edge of buckets, as one that
    a third of all rows have is, is a bucket of its own, whose rows need no order and are dealt to several tasks."""
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    base = df.where(F.col(label).isNotNull()).groupBy(group.alias("g"), F.xxhash64(F.col(cluster)).alias("c"), *[F.col(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)], F.col(label).alias("y"))
    long = base.agg(F.count("*").alias("n")).select("g", "c", "y", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"s{i}").alias("v")) for i in range(len(scores))])).alias("_x"))
    long = saved(long.select("g", "c", "y", "n", "_x.*").where("v is not null"))
    bounds = F.lit(cuts(long, "v")).cast("array<double>")
    bucket = 2 * F.size(F.filter(bounds, lambda b: b < F.col("v"))) + F.array_contains(bounds, F.col("v")).cast("int")
    placed = long.withColumn("b", bucket).withColumn("salt", F.when(F.col("b") % 2 == 1, F.pmod("c", F.lit(_SALTS))).otherwise(0).cast("int"))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, area = None, None
        made = lambda: pd.DataFrame([(*key[:3], *area.row())], columns=["g", "which", "b", "area", "pos", "neg"])
        for part in parts:
            for lo in range(0, len(part), _STRIP):
                strip = part.iloc[lo : lo + _STRIP]
                weights = replicate_weights(strip["c"].to_numpy(), resamples) * strip["n"].to_numpy()[:, None]
                v, y = strip["v"].to_numpy(), strip["y"].to_numpy(dtype=bool)
                keys = list(zip(strip["g"], strip["which"], strip["b"], strip["salt"], strict=True))
                edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
                for a, z in zip(edges, edges[1:], strict=False):
                    if keys[a] != key:
                        if key is not None:
                            yield made()
                        key, area = keys[a], _Area(resamples)
                    area.add(v[a:z], y[a:z], weights[a:z])
        if key is not None:
            yield made()

    ordered = placed.repartition("g", "which", "b", "salt").sortWithinPartitions("g", "which", "b", "salt", "v")
    vectors = ordered.select("g", "which", "b", "salt", "v", "y", "c", "n").mapInPandas(sums, "g string, which int, b int, area array<double>, pos array<double>, neg array<double>")

    def areas(rows: pd.DataFrame) -> pd.DataFrame:  # a few rows a bucket
        out = []
        for i in range(len(scores)):
            total, pos, neg = np.zeros(resamples), np.zeros(resamples), np.zeros(resamples)
            for b, parts in sorted(rows[rows["which"] == i].groupby("b"), key=lambda x: x[0]):
                p, n = np.sum(np.stack(parts["pos"]), axis=0), np.sum(np.stack(parts["neg"]), axis=0)
                total += p * neg + (p * n / 2 if b % 2 else np.sum(np.stack(parts["area"]), axis=0))
                pos, neg = pos + p, neg + n
            good = (pos > 0) & (neg > 0)
            out.append([float(x) if ok else None for x, ok in zip(np.divide(total, pos * neg, where=good, out=np.zeros(resamples)), good, strict=True)])
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "aucs": [out]})

    found = vectors.groupBy("g").applyInPandas(areas, "g string, aucs array<array<double>>")
    return found.select("aucs") if by is None else found.select(F.when(F.col("g") != "\0", F.col("g")).cast(df.schema[by].dataType).alias(by), "aucs")


def bootstrap_gap(df: DataFrame, champion: str, challenger: str, label: str, cluster: str, resamples: int = 500) -> DataFrame:
    """Interval of the AUC gap of two scores by a paired bootstrap over clusters; one row. Rows without either score are
    left out, as are replicates of one class."""
    both = df.where(F.col(champion).isNotNull() & F.col(challenger).isNotNull())
    aucs = bootstrap_aucs(both, [champion, challenger], label, cluster, None, resamples)
    gap = aucs.select(F.explode(F.zip_with(F.col("aucs")[1], F.col("aucs")[0], lambda b, a: b - a)).alias("gap")).where("gap is not null")
    return gap.agg(F.count("*").alias("resamples"), F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"))


def bootstrap_interval(df: DataFrame, score: str, label: str, cluster: str, by: str, resamples: int = 500) -> DataFrame:
    """(``by, low, high``): the interval of each slice's AUC by a bootstrap over clusters."""
    aucs = bootstrap_aucs(df, [score], label, cluster, by, resamples)
    each = aucs.select(by, F.explode(F.col("aucs")[0]).alias("auc")).where("auc is not null")
    return each.groupBy(by).agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"))


def promotion(runs: DataFrame, margin: float, wins_needed: int, min_rows: int) -> DataFrame:
    """Verdict on the newest runs: a run wins by the margin on both splits; runs on data seen before don't count.

    ``runs``: ``trained_at, champion, challenger, time_champion, time_challenger, content, n``. The streak is the
    number of wins from the newest run back to the first that isn't one.
    """
    won = (F.col("challenger") - F.col("champion") >= margin) & (F.col("time_challenger") >= F.col("time_champion"))
    distinct = runs.groupBy("content").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "content"]), "trained_at").alias("x")).select("content", "x.*")
    recent = W.orderBy(F.desc("trained_at")).rowsBetween(W.unboundedPreceding, 0)  # a history of runs is short
    flags = distinct.withColumn("won", F.coalesce(won, F.lit(False)).cast("int")).withColumn("streak", F.min("won").over(recent))
    out = flags.agg(F.sum("streak").alias("streak"), F.max_by("n", "trained_at").alias("n"), F.count("*").alias("distinct_runs"))
    verdict = F.when(F.col("n") < min_rows, "small sample").when(F.col("streak") >= wins_needed, "promote").otherwise("keep")
    return out.withColumn("verdict", verdict)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return rounded(F.greatest((middle - width) / scale, F.lit(0.0)), 4), rounded(F.least((middle + width) / scale, F.lit(1.0)), 4)


def claims(candidates: DataFrame) -> DataFrame:
    """Up to three claims of each candidate with threshold and horizon: price reverts, offers rise, sales hold."""
    make = lambda on, kind, limit, days: F.when(on, F.struct(F.lit(kind).alias("claim"), limit.cast("double").alias("threshold"), F.lit(days).alias("horizon")))
    price, offers = F.col("price"), F.col("offers")
    found = F.array_compact(
        F.array(
            make(price > 1.15 * F.col("avg_price_90"), "price_reversion", F.col("avg_price_90"), 14),
            make(offers > 1.4 * F.col("avg_offers_90"), "offer_trend", offers, 14),
            make(F.col("est_sales") > 0, "velocity", rounded(F.col("est_sales") * 0.7, 2), 30),
        )
    )
    return candidates.withColumn("_c", F.explode(found)).select("item", "made_at", "_c.*")


def resolve_claims(made: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """Matured claims against fresh facts: whether each came true."""
    due = made.where(F.datediff(now, "made_at") >= F.col("horizon")).join(stats, "item")
    hit = (
        F.when(F.col("claim") == "price_reversion", F.col("price_now") <= F.col("threshold"))
        .when(F.col("claim") == "offer_trend", F.col("offers_now") >= F.col("threshold"))
        .otherwise(F.col("sales_now") >= F.col("threshold"))
    )
    return due.withColumn("hit", hit)


def alternate(df: DataFrame, side: str, order: list[str], n: int) -> DataFrame:
    """Clear cases from both sides in turn, ``n`` in all. No side needs more than its first ``n``, which every task finds
    for itself before the shuffle."""
    rows = df.withColumn("turn", F.row_number().over(W.partitionBy(side).orderBy(*order))).where(F.col("turn") <= n)
    return rows.orderBy("turn", F.desc(side)).limit(n)


def promote_newest(registry: DataFrame, margin: float = 0.02) -> DataFrame:
    """Second-generation gate over (``name, created, pr_auc``): the newest model replaces the one before it if it is
    better by the margin; the first one is promoted, an unknown measure keeps the old one; one row a name."""
    w = W.partitionBy("name").orderBy(F.desc("created"))  # a few models a name
    two = registry.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    out = two.groupBy("name").agg(
        F.count("*").alias("models"), F.max(F.when(F.col("_r") == 1, F.col("pr_auc"))).alias("challenger"), F.max(F.when(F.col("_r") == 2, F.col("pr_auc"))).alias("champion")
    )
    better = F.coalesce((F.col("challenger") - F.col("champion")).cast("decimal(18,6)") >= margin, F.lit(False))
    return out.withColumn("promoted", (F.col("models") == 1) | better)


def regressions(runs: DataFrame) -> DataFrame:
    """Metrics (``metric, run, value``) that fell from the run before; runs are numbered."""
    last = F.lag("value").over(W.partitionBy("metric").orderBy("run"))  # a short history a metric
    return runs.withColumn("before", last).where(F.col("value") < F.col("before"))
