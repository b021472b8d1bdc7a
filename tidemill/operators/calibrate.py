"""Probabilities that mean what they say: isotonic regression by pool-adjacent-violators, and a logistic one for few rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.folders import saved

#: Distinct scores that are pooled in one task, and pooled ranges that are then pooled together.
IN_ONE, TOGETHER = 50_000, 64
#: Fewer rows than this get a logistic curve.
LEAST = 200


def pooled(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, pos: np.ndarray) -> list[tuple[float, float, int, int]]:
    """Blocks (lo, hi, n, pos), in order of score, whose rates don't fall; neighbours that fall become one block."""
    out: list[tuple[float, float, int, int]] = []
    for block in zip(lo.tolist(), hi.tolist(), n.tolist(), pos.tolist(), strict=True):
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:  # rates in whole numbers
            last = out.pop()
            block = (last[0], block[1], last[2] + block[2], last[3] + block[3])
        out.append(block)
    return out


def _pool(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("lo")
    blocks = pooled(part["lo"].to_numpy(), part["hi"].to_numpy(), part["n"].to_numpy(), part["pos"].to_numpy())
    return pd.DataFrame(blocks, columns=["lo", "hi", "n", "pos"]).assign(part=part["part"].iloc[0] if len(part) else 0)


def isotonic_blocks(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The isotonic fit of a boolean label to a score: blocks (``lo, hi, n, pos``) of scores with one rate each, rising.

    Rows are counted by distinct score. Pooling a range of scores for itself leaves blocks that the whole fit pools
    too, so ordered ranges of about IN_ONE scores are pooled first, each in a task, then TOGETHER neighbouring ranges at
    a time, until one is left. A range's blocks grow far slower than its scores. Rows without score or label are left
    out."""
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("lo"))
    counts = saved(counts.agg(F.count("*").alias("n"), F.count_if(label).alias("pos")))
    parts = -(-max(1, counts.count()) // IN_ONE)
    edges = sorted(set(counts.approxQuantile("lo", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    at = F.lit(0)
    if edges:  # a search in steps of halves, so that thousands of edges cost a dozen comparisons
        ordered = F.lit(edges)
        at = F.lit(0)
        step = 1 << (len(edges).bit_length() - 1)
        while step:
            at = F.when((at + step <= len(edges)) & (F.get(ordered, at + step - 1) < F.col("lo")), at + step).otherwise(at)
            step >>= 1
    blocks = counts.select("lo", F.col("lo").alias("hi"), "n", "pos", at.cast("int").alias("part"))
    schema = "lo double, hi double, n long, pos long, part int"
    while True:
        blocks = blocks.groupBy("part").applyInPandas(_pool, schema)
        if parts <= 1:
            return blocks.drop("part")
        blocks, parts = saved(blocks.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("int"))), -(-parts // TOGETHER)


@dataclass(frozen=True)
class Calibration:
    """A rising curve through ``knots`` (score, probability), straight between them; or, without any, a logistic one."""

    knots: tuple[tuple[float, float], ...]
    slope: float = 0.0
    constant: float = 0.0

    def apply(self, rows: DataFrame, score: str, alias: str) -> DataFrame:
        """``rows`` with the calibrated probability; a null score has none."""
        x = F.col(score).cast("double")
        if not self.knots:
            odds = F.lit(self.slope) * self.logit(x) + self.constant
            return rows.withColumn(alias, F.when(x.isNotNull(), 1 / (1 + F.exp(-odds))))
        shared = rows.sparkSession.sparkContext.broadcast(np.array(self.knots).T)  # two numbers a block

        @F.pandas_udf("double")
        def curve(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            at, value = shared.value
            for s in parts:
                yield pd.Series(np.where(s.isna(), np.nan, np.interp(s, at, value)), index=s.index)

        return rows.withColumn(alias, F.nanvl(curve(x), F.lit(None).cast("double")))

    @staticmethod
    def logit(p):  # noqa: ANN001, ANN205
        q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        return F.log(q / (1 - q))


def fit_calibration(rows: DataFrame, score: str, label: str, least: int = LEAST) -> Calibration:
    """Isotonic for ``least`` rows or more, else a logistic curve over the log odds of the score."""
    some = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    n = some.limit(least).count()
    if n >= least:
        knots: list[tuple[float, float]] = []
        for b in isotonic_blocks(some, score, label).orderBy("lo").collect():  # blocks, far fewer than scores
            knots += [(b["lo"], b["pos"] / b["n"])] + ([(b["hi"], b["pos"] / b["n"])] if b["hi"] > b["lo"] else [])
        return Calibration(tuple(knots))
    both = some.agg(F.count_if(label).alias("p"), F.count("*").alias("n")).first()
    if both["p"] in (0, both["n"]):
        rate = (both["p"] + 1) / (both["n"] + 2)
        return Calibration((), 0.0, math.log(rate / (1 - rate)))
    ready = some.select(array_to_vector(F.array(Calibration.logit(F.col(score).cast("double")))).alias("features"), F.col(label).cast("double").alias("label"))
    fit = LogisticRegression(maxIter=50).fit(ready)
    return Calibration((), float(fit.coefficients[0]), float(fit.intercept))
