"""Walk-forward evaluation: a model for each purged fold, all fitted from one pass of sums."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    """A linear score: weights of the columns, then the constant."""

    weights: tuple[float, ...]

    def score(self, columns: list[Column]) -> Column:
        return sum((F.lit(w) * c for w, c in zip(self.weights[:-1], columns, strict=True)), F.lit(self.weights[-1]))


def terms(features: list[str]) -> list[Column]:
    """Each feature with missing values as 0, and a flag that it is missing."""
    value = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    return [*value, *[F.when(F.col(f).isNull(), 1.0).otherwise(0.0) for f in features]]


def sums_by_segment(rows: DataFrame, features: list[str], label: str, segment: Column) -> dict[int, np.ndarray]:
    """For each segment the sums of products of all pairs of (terms, 1, label): all that least squares need. One grouped
    sum; null segments are left out."""
    cols = [*terms(features), F.lit(1.0), F.col(label).cast("double")]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    out = rows.where(F.col(label).isNotNull()).groupBy(segment.alias("_segment")).agg(*[F.sum(cols[i] * cols[j]).alias(f"p{n}") for n, (i, j) in enumerate(pairs)])
    found = {}
    for r in out.where("_segment is not null").collect():  # a row for each segment
        m = np.zeros((k, k))
        for n, (i, j) in enumerate(pairs):
            m[i, j] = m[j, i] = r[f"p{n}"]
        found[r["_segment"]] = m
    return found


def ridge(moments: np.ndarray, strength: float = 1e-3) -> Linear:
    """Least squares on standardised terms, from the sums of products; a term that doesn't vary has no weight."""
    k = len(moments) - 2
    n = moments[k, k]
    mean, to_label = moments[:k, k] / n, moments[:k, k + 1] / n - moments[:k, k] / n * moments[k, k + 1] / n
    cov = moments[:k, :k] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    on = scale > 1e-9 * np.maximum(1, np.abs(mean))
    w = np.zeros(k)
    if on.any():
        s = scale[on]
        w[on] = np.linalg.solve(cov[np.ix_(on, on)] / np.outer(s, s) + strength * np.eye(on.sum()), to_label[on] / s) / s
    return Linear((*w.tolist(), float(moments[k, k + 1] / n - w @ mean)))


def walk_forward(rows: DataFrame, features: list[str], label: str, day: str, folds: list[tuple[int, dt.date, dt.date]], embargo: int = 60, least: int = 30) -> DataFrame:
    """Test rows of each fold (number, start, stop) with ``fold`` and the ``score`` of that fold's model, which is fitted
    on the rows more than ``embargo`` days before the fold's start. Folds have rising starts and don't overlap.

    A row trains every later fold, so rows are summed once, by the first fold that they train, and a fold's sums are
    those of its segment and of all before. A fold with fewer than ``least`` training rows, or one class, has no rows."""
    first = F.lit(None).cast("int")
    for number, start, _ in reversed(folds):
        first = F.when(F.col(day) < F.date_sub(F.lit(start), embargo), number).otherwise(first)
    sums = sums_by_segment(rows, features, label, first)
    so_far, models = None, {}
    for number, _, _ in folds:
        if number in sums:
            so_far = sums[number] if so_far is None else so_far + sums[number]
        if so_far is not None and so_far[-2, -2] >= least and 0 < so_far[-2, -1] < so_far[-2, -2]:
            models[number] = ridge(so_far)
    fold, score = F.lit(None).cast("int"), F.lit(None).cast("double")
    columns = terms(features)
    for number, start, stop in folds:
        if number in models:
            inside = (F.col(day) >= F.lit(start)) & (F.col(day) < F.lit(stop))
            fold = F.when(inside, number).otherwise(fold)
            score = F.when(inside, models[number].score(columns)).otherwise(score)
    return rows.withColumn("fold", fold).withColumn("score", score).where("fold is not null")


def even_folds(rows: DataFrame, day: str, k: int, train: float = 0.4) -> list[tuple[int, dt.date, dt.date]]:
    """``k`` folds of like length over the days after the first ``train`` share of the time."""
    span = rows.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).first()
    if span["a"] is None:
        return []
    days = (span["b"] - span["a"]).days + 1
    at = [span["a"] + dt.timedelta(round(days * (train + (1 - train) * i / k))) for i in range(k + 1)]
    return [(i + 1, at[i], at[i + 1]) for i in range(k) if at[i] < at[i + 1]]
