"""Gradient boosting on histograms: quantile regressors, and rankers with a listwise loss.

Features are binned once. A tree grows level by level; a level takes one grouped sum over the rows, of what each node,
feature and bin holds, so rows stay where they are and the driver sees some hundred sums. A tree is a few splits, kept on
the driver and applied as nested conditions in generated code."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.folders import saved

#: Trees after which the scores of the rows are written anew, so that no expression names more.
SAVED_EVERY = 6


@dataclass(frozen=True)
class Bins:
    """Upper edges of each feature's bins; bin 0 is for missing values."""

    edges: dict[str, list[float]]

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], n: int = 32) -> Bins:
        """Edges from approximate quantiles of all rows, in one pass."""
        doubles = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
        cuts = doubles.approxQuantile(features, [i / n for i in range(1, n)], 1 / (8 * n))
        return cls({f: sorted({c for c in cut if c is not None and not math.isnan(c)}) for f, cut in zip(features, cuts, strict=True)})

    def columns(self) -> Column:
        """An array of bins: 1 + the number of edges below the value."""
        at = [F.when(F.col(f).isNotNull(), sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges), F.lit(1))).otherwise(0) for f, edges in self.edges.items()]
        return F.array(*[a.cast("short") for a in at])


@dataclass
class Tree:
    """Nodes in heap order from 1; ``splits`` sends a row left if its bin of the feature is at most the bin."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def _walk(self, x: Column, node: int, leaf) -> Column:  # noqa: ANN001
        if node not in self.splits:
            return leaf(node)
        feature, b = self.splits[node]
        return F.when(x[feature] <= b, self._walk(x, 2 * node, leaf)).otherwise(self._walk(x, 2 * node + 1, leaf))

    def leaf(self, x: Column) -> Column:
        return self._walk(x, 1, F.lit)

    def value(self, x: Column) -> Column:
        return self._walk(x, 1, lambda node: F.lit(self.values.get(node, 0.0)))


@dataclass
class Boosted:
    bins: Bins
    start: float
    trees: list[Tree]

    def score(self, rows: DataFrame, alias: str) -> DataFrame:
        """``rows`` with the model's value; the bins are computed once a row."""
        out = rows.select("*", F.explode(F.array(self.bins.columns())).alias("_x"))
        return out.withColumn(alias, sum((t.value(F.col("_x")) for t in self.trees), F.lit(self.start))).drop("_x")


def grow(rows: DataFrame, g: Column, h: Column, depth: int, least: float, smooth: float = 0.0) -> Tree:
    """A tree over ``x`` (bins) that parts gradients ``g`` with weights ``h``: each split gains most in the sum of
    G * G / (H + smooth), with ``least`` of the weight on either side; ties go to the first feature and bin."""
    tree = Tree()
    for level in range(depth):
        node = tree.leaf(F.col("x"))
        at = rows.select(node.alias("node"), g.alias("g"), h.alias("h"), F.posexplode("x").alias("f", "b"))
        if level:
            at = at.where(F.col("node") >= 1 << level)  # nodes that the last level made
        sums: dict[int, dict[int, list[tuple[int, float, float]]]] = {}
        for r in at.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
            sums.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
        made = False
        for node, features in sums.items():
            best = (1e-9, None)
            for f, cells in sorted(features.items()):
                cells.sort()
                whole_g, whole_h = math.fsum(c[1] for c in cells), math.fsum(c[2] for c in cells)
                left_g = left_h = 0.0
                for b, cell_g, cell_h in cells[:-1]:
                    left_g, left_h = left_g + cell_g, left_h + cell_h
                    right_g, right_h = whole_g - left_g, whole_h - left_h
                    if min(left_h, right_h) < least:
                        continue
                    gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - whole_g**2 / (whole_h + smooth)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, b))
            if best[1] is not None:
                tree.splits[node], made = best[1], True
        if not made:
            break
    return tree


def quantile_trees(rows: DataFrame, features: list[str], target: str, tau: float, trees: int = 12, depth: int = 3, rate: float = 0.3, least: int = 20, bins: int = 32) -> Boosted:
    """A boosted regressor of the ``tau`` quantile of a target (pinball loss), on all rows that have one.

    A level's gradients are counts of rows above and below. A tree takes them once, by combination of bins, since rows
    of one have the same score, and its levels sum those counts; a leaf's value is the quantile of what is left in it,
    from a mergeable summary (``percentile_approx``, exact for up to 10,000 rows a leaf, else within a ten-thousandth of
    the rank)."""
    some = rows.where(F.col(target).isNotNull())
    made = Bins.of(some, features, bins)
    data = saved(some.select(made.columns().alias("x"), F.col(target).cast("double").alias("y")))
    quantile = lambda c: F.percentile_approx(c, F.lit(tau), F.lit(10_000))
    start = data.agg(quantile(F.col("y"))).first()[0]
    model = Boosted(made, start or 0.0, [])
    if start is None:
        return model
    data = data.withColumn("s", F.lit(start))
    for k in range(trees):
        cells = saved(data.groupBy("x").agg(F.count("*").alias("n"), F.count_if(F.col("y") > F.col("s")).alias("above")))
        tree = grow(cells, F.col("above") * tau - (F.col("n") - F.col("above")) * (1 - tau), F.col("n"), depth, least)
        left = data.groupBy(tree.leaf(F.col("x")).alias("leaf")).agg(quantile(F.col("y") - F.col("s")).alias("v"))
        tree.values = {r["leaf"]: rate * r["v"] for r in left.collect()}  # 2 ** depth at most
        model.trees.append(tree)
        data = data.withColumn("s", F.col("s") + tree.value(F.col("x")))
        if k % SAVED_EVERY == SAVED_EVERY - 1 and k + 1 < trees:
            data = saved(data)
    return model


# ---- Ranking

#: Scores count as equal in steps of 1 / STEPS, from -MOST to MOST, so a group has a bounded number of different ones.
STEPS, MOST = 1024, 8
#: Ranks whose discounts are summed one by one; beyond them the sum is an integral, right to a millionth.
_SUMMED = 1 << 16


def _li(x: np.ndarray) -> np.ndarray:
    """The logarithmic integral, by its series."""
    u = np.log(x)
    term, total = np.ones_like(u), np.zeros_like(u)
    for k in range(1, 200):
        term = term * u / k
        total += term / k
    return np.euler_gamma + np.log(u) + total


_RANKS = np.arange(1, _SUMMED + 1)
_DISCOUNTS = np.concatenate([[0.0], np.cumsum(1 / np.log2(_RANKS + 1.0))])
_BY_RANK = np.concatenate([[0.0], np.cumsum(_RANKS / np.log2(_RANKS + 1.0))])


def discounts(k: np.ndarray) -> np.ndarray:
    """Sum of the discounts 1 / log2(1 + r) of the ranks r = 1 .. k."""
    k = np.asarray(k, dtype=float)
    far = math.log(2) * (_li(np.maximum(k, _SUMMED) + 1.5) - _li(np.full_like(k, _SUMMED + 1.5)))
    return _DISCOUNTS[np.minimum(k, _SUMMED).astype(np.int64)] + far


def discounts_by_rank(k: np.ndarray) -> np.ndarray:
    """Sum of r / log2(1 + r) over the ranks r = 1 .. k."""
    k = np.asarray(k, dtype=float)
    whole = lambda u: _li(u * u) - _li(u)
    far = math.log(2) * (whole(np.maximum(k, _SUMMED) + 1.5) - whole(np.full_like(k, _SUMMED + 1.5)))
    return _BY_RANK[np.minimum(k, _SUMMED).astype(np.int64)] + far


def lambdas(score: np.ndarray, positives: np.ndarray, negatives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and weights of a group's blocks of equal score: (g of a positive row, of a negative one, h, h).

    Each pair of a positive and a negative row counts by the NDCG that changing their places would change. Rows of equal
    score are taken in all orders: each has the mean discount of their ranks, and two of them the mean difference of
    two. ``g`` is minus the gradient: it points where scores should go."""
    order = np.argsort(-score, kind="stable")
    s, p, n = score[order], positives[order].astype(float), negatives[order].astype(float)
    ends = np.cumsum(p + n)
    sums = discounts(np.concatenate([[0.0], ends]))
    gain = np.diff(sums) / np.maximum(p + n, 1)
    before, m = ends - (p + n), p + n
    within = (m + 1 + 2 * before) * np.diff(sums) - 2 * np.diff(discounts_by_rank(np.concatenate([[0.0], ends])))
    within = within / np.maximum(m * (m - 1) / 2, 1)
    ideal = discounts(np.array([p.sum()]))[0]
    out = np.zeros((4, len(s)))
    if ideal > 0:
        for lo in range(0, len(s), 512):  # blocks in strips, so memory follows their number
            a = slice(lo, lo + 512)
            miss = 1 / (1 + np.exp(np.clip(s[a, None] - s[None, :], -50, 50)))  # of a positive row in a over a negative one
            weight = np.abs(gain[a, None] - gain[None, :])
            at = np.arange(len(weight))
            weight[at, lo + at] = within[a]
            weight /= ideal
            pull, curve = weight * miss, weight * miss * (1 - miss)
            out[0, a], out[2, a] = pull @ n, curve @ n
            out[1] -= p[a] @ pull
            out[3] += p[a] @ curve
    back = np.empty_like(out)
    back[:, order] = out
    return tuple(back)


def _group_gradients(blocks: pd.DataFrame) -> pd.DataFrame:
    g1, g0, h1, h0 = lambdas(blocks["block"].to_numpy() / STEPS, blocks["p"].to_numpy(), blocks["n"].to_numpy())
    return blocks[["group", "block"]].assign(g1=g1, g0=g0, h1=h1, h0=h0)


def ranking_trees(rows: DataFrame, features: list[str], label: str, group: str, trees: int = 12, depth: int = 3, rate: float = 0.3, least: float = 1e-3, bins: int = 16, smooth: float = 1e-3) -> Boosted:
    """A boosted ranker of rows with a boolean label within each group, trained on NDCG (lambda gradients).

    Rows that agree in group, bins and label are one with a count, so a group of any size has as many as there are
    combinations of bins at most. A round counts each group's rows by score (``STEPS``), takes gradients from these
    counts, and joins them to the rows. Rows without a label are left out; null groups are a group."""
    some = rows.where(F.col(label).isNotNull())
    made = Bins.of(some, features, bins)
    key = F.coalesce(F.col(group).cast("string"), F.lit("\0")).alias("group")
    data = some.select(key, made.columns().alias("x"), F.col(label).cast("boolean").alias("y")).groupBy("group", "x", "y").agg(F.count("*").alias("n"))
    data = saved(data.withColumn("s", F.lit(0.0)))
    model = Boosted(made, 0.0, [])
    for k in range(trees):
        block = F.greatest(F.lit(-MOST * STEPS), F.least(F.lit(MOST * STEPS), F.round(F.col("s") * STEPS))).cast("int")
        marked = data.withColumn("block", block)
        counts = marked.groupBy("group", "block").agg(F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("y"), F.col("n")).otherwise(0)).alias("n"))
        slopes = counts.groupBy("group").applyInPandas(_group_gradients, "group string, block int, g1 double, g0 double, h1 double, h0 double")
        ready = saved(marked.join(slopes, ["group", "block"]).select("x", "n", F.when(F.col("y"), F.col("g1")).otherwise(F.col("g0")).alias("g"), F.when(F.col("y"), F.col("h1")).otherwise(F.col("h0")).alias("h")))
        tree = grow(ready, F.col("g") * F.col("n"), F.col("h") * F.col("n"), depth, least, smooth)
        sums = ready.groupBy(tree.leaf(F.col("x")).alias("leaf")).agg(F.sum(F.col("g") * F.col("n")).alias("g"), F.sum(F.col("h") * F.col("n")).alias("h"))
        tree.values = {r["leaf"]: rate * max(-2.0, min(2.0, r["g"] / (r["h"] + smooth))) for r in sums.collect()}
        if not tree.splits:
            break
        model.trees.append(tree)
        data = data.withColumn("s", F.col("s") + tree.value(F.col("x")))
        if k % SAVED_EVERY == SAVED_EVERY - 1 and k + 1 < trees:
            data = saved(data)
    return model
