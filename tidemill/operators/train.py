"""Training and scoring of rankers on typed feature columns, and what calibration they have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.operators import evaluate as E
from tidemill.sources.folders import saved


def refusal(rows: DataFrame, label: str, least: int = D.MIN_TRAINING_ROWS) -> str | None:
    """Why a corpus can't be trained on: too few rows, or one class."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(label).alias("pos")).first()
    if n["n"] < least:
        return "too few rows"
    return "one class" if n["pos"] in (0, n["n"]) else None


def fit_classifier(rows: DataFrame, features: list[str], label: str, weight: str | None = None, trees: bool = False) -> PipelineModel:
    """Median-imputed features into a logistic regression, or boosted trees; rows may be weighted by tier."""
    ready = rows.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y"), *([weight] if weight else []))
    filled = [f"{f}_filled" for f in features]
    kind = GBTClassifier if trees else LogisticRegression
    model = kind(featuresCol="_x", labelCol="_y", **({"weightCol": weight} if weight else {}), **({"maxIter": 20, "seed": 7} if trees else {"maxIter": 50, "regParam": 0.01}))
    model.set(model.getParam("probabilityCol"), "_p") if model.hasParam("probabilityCol") else None
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x"), model]).fit(ready)


def probabilities(model: PipelineModel, rows: DataFrame, features: list[str], alias: str = "probability") -> DataFrame:
    scored = model.transform(rows.withColumns({f: F.col(f).cast("double") for f in features}))
    out = scored.withColumn(alias, F.round(vector_to_array("_p")[1], 6))
    return out.select(*rows.columns, alias)


def quantile_line(rows: DataFrame, features: list[str], target: str, tau: float, steps: int = 25) -> list[float]:
    """A linear quantile model; the last number is the constant. Rows with a missing value are left out.

    Weighted least squares in rounds: a row's weight is tau, or 1 - tau below the line, by its distance from it, so that
    the squares add up to the pinball loss. A round is one sum over all rows of the products of their columns, by matrix
    products over batches: as expressions they would be compiled anew each round, and run cold. Only sums reach the
    driver."""
    cols = [F.col(c).cast("double") for c in [*features, target]]
    data = saved(rows.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).dropna())
    k = len(features)
    first = data.agg(F.count("*").alias("n"), *[f(f"c{i}").alias(f"{n}{i}") for i in range(k + 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.percentile_approx(f"c{k}", F.lit(tau)).alias("q")).first()
    if not first["n"]:
        return [0.0] * (k + 1)
    mean, scale = [first[f"m{i}"] for i in range(k)], [first[f"s{i}"] or 1.0 for i in range(k + 1)]
    middle, width = np.array(mean), np.array(scale[:k])
    w = np.append(np.zeros(k), first["q"])
    for step in range(steps):
        near = scale[k] * max(1e-4, 0.5**step)

        def products(parts: Iterator[pd.DataFrame], w: np.ndarray = w, near: float = near) -> Iterator[pd.DataFrame]:
            total = np.zeros((k + 2, k + 1))
            for part in parts:
                values = part.to_numpy(dtype=float)
                z, y = np.column_stack([(values[:, :k] - middle) / width, np.ones(len(values))]), values[:, k]
                left = y - z @ w
                weighted = z * (np.where(left >= 0, tau, 1 - tau) / np.maximum(np.abs(left), near))[:, None]
                total[:-1] += weighted.T @ z
                total[-1] += y @ weighted
            yield pd.DataFrame({"sums": [total.ravel().tolist()]})

        found = data.mapInPandas(products, "sums array<double>").collect()  # a row a task
        total = np.sum([r["sums"] for r in found], axis=0).reshape(k + 2, k + 1)
        m, b = total[:-1], total[-1]
        w = np.linalg.solve(m + 1e-9 * np.trace(m) / (k + 1) * np.eye(k + 1), b)
    plain = w[:-1] / width
    return [*plain.tolist(), float(w[-1] - plain @ middle)]


def calibration_summary(rows: DataFrame, features: list[str], label: str, fold: Column) -> DataFrame:
    """Trains on fold ``train``, and bins the predictions of the others by probability."""
    marked = rows.withColumn("_fold", fold)
    model = fit_classifier(marked.where("_fold = 'train'"), features, label)
    held = probabilities(model, marked.where("_fold <> 'train'"), features)
    return E.calibration_bins(held, "probability", label)
