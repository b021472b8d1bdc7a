"""Calibration, boosting, walk-forward fits and the bootstrap against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import boosting as G
from tidemill.operators import calibrate as C
from tidemill.operators import evaluate as E
from tidemill.operators import walkforward as WF
from tidemill.plans import learning

SF = "/root/testdata/sf0.001"


def plain_isotonic(rows):
    """Max over starts of the min over ends of the mean between, by distinct score."""
    s = sorted({a for a, _ in rows})
    n = [sum(a == x for a, _ in rows) for x in s]
    p = [sum(a == x and y for a, y in rows) for x in s]
    mean = lambda i, j: sum(p[i : j + 1]) / sum(n[i : j + 1])
    return {x: max(min(mean(j, m) for m in range(k, len(s))) for j in range(k + 1)) for k, x in enumerate(s)}


@pytest.mark.parametrize(("one", "together"), [(50_000, 64), (7, 2), (1, 3)])
def test_isotonic_blocks(spark, monkeypatch, one, together):
    monkeypatch.setattr(C, "IN_ONE", one)
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = random.Random(1)
    rows = [(rng.randint(0, 60) / 60, None) for _ in range(400)]
    rows = [(a, rng.random() < a * a) for a, _ in rows]
    frame = spark.createDataFrame([*rows, (None, True), (0.5, None)], "s double, y boolean")
    blocks = C.isotonic_blocks(frame, "s", "y").orderBy("lo").collect()
    want = plain_isotonic(rows)
    got = {x: b.pos / b.n for b in blocks for x in want if b.lo <= x <= b.hi}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert all(a.pos / a.n < b.pos / b.n and a.hi < b.lo for a, b in zip(blocks, blocks[1:], strict=False))


def test_calibration_curves(spark):
    rng = random.Random(2)
    rows = [(i, x := rng.random(), rng.random() < x**3) for i in range(600)]
    frame = spark.createDataFrame([*rows, (-1, None, True)], "i long, s double, y boolean")
    for least in (200, 10_000):  # isotonic, logistic
        fit = C.fit_calibration(frame, "s", "y", least)
        out = {r.i: r.p for r in fit.apply(frame, "s", "p").collect()}
        assert out[-1] is None
        raw = math.fsum(x - y for _, x, y in rows) / 600
        assert abs(math.fsum(out[i] - y for i, _, y in rows) / 600) < abs(raw) / 5
        by_score = [out[i] for i, _, _ in sorted(rows, key=lambda r: r[1])]
        assert all(a <= b + 1e-12 for a, b in zip(by_score, by_score[1:], strict=False))
    empty = C.fit_calibration(frame.where("i > 5000"), "s", "y")
    assert 0 < empty.apply(frame, "s", "p").where("i = 0").first().p < 1


def plain_quantile_trees(x, y, tau, trees, depth, rate, least):
    """The same trees with loops over rows; ``x`` are bins."""
    def quantile(v):
        v = sorted(v)
        return v[max(0, math.ceil(tau * len(v)) - 1)]

    score = np.full(len(y), quantile(y))
    for _ in range(trees):
        grad = np.where(y > score, tau, tau - 1)
        leaves = [(1, np.arange(len(y)))]
        for _ in range(depth):
            out = []
            for node, rows in leaves:
                best, cut = 1e-9, None
                for f in range(x.shape[1]):
                    for b in sorted(set(x[rows, f]))[:-1]:
                        left = x[rows, f] <= b
                        nl, nr = left.sum(), (~left).sum()
                        if min(nl, nr) < least:
                            continue
                        gain = grad[rows][left].sum() ** 2 / nl + grad[rows][~left].sum() ** 2 / nr - grad[rows].sum() ** 2 / len(rows)
                        if gain > best * (1 + 1e-9):
                            best, cut = gain, (f, b)
                if cut is None:
                    out.append((node, rows))
                else:
                    left = x[rows, cut[0]] <= cut[1]
                    out += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
            leaves = out
        step = np.zeros(len(y))
        for _, rows in leaves:
            step[rows] = rate * quantile(y[rows] - score[rows])
        score = score + step
    return score


def test_quantile_trees_equal_a_plain_version(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 9, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    y = np.round(3 * a + (b > 2) * 10 + rng.exponential(4, 300), 3)
    frame = spark.createDataFrame([(float(i), None if i % 29 == 0 else float(p), float(q), float(t)) for i, (p, q, t) in enumerate(zip(a, b, y, strict=True))], "i double, a double, b double, y double")
    model = G.quantile_trees(frame, ["a", "b"], "y", 0.2, trees=8, depth=2, least=10)
    out = model.score(frame.select("*", model.bins.columns().alias("bins")), "q").orderBy("i").collect()
    want = plain_quantile_trees(np.array([r.bins for r in out]), y, 0.2, 8, 2, 0.3, 10)
    assert np.allclose([r.q for r in out], want, atol=1e-9)
    assert not G.quantile_trees(frame.where("i < 0"), ["a", "b"], "y", 0.2).trees


def plain_lambdas(scores, labels):
    """Sums over pairs of rows; rows of equal score are taken in all orders."""
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    rank = {i: k + 1 for k, i in enumerate(order)}
    disc, within = {}, {}
    for s in set(scores):
        same = [i for i in range(len(scores)) if scores[i] == s]
        d = sum(1 / math.log2(1 + rank[i]) for i in same) / len(same)
        disc.update(dict.fromkeys(same, d))
        two = [abs(1 / math.log2(1 + rank[i]) - 1 / math.log2(1 + rank[j])) for i in same for j in same if i < j]
        within[s] = sum(two) / len(two) if two else 0.0
    ideal = sum(1 / math.log2(2 + k) for k in range(sum(labels)))
    g, h = [0.0] * len(scores), [0.0] * len(scores)
    for i in range(len(scores)):
        for j in range(len(scores)):
            if labels[i] and not labels[j]:
                w = (within[scores[i]] if scores[i] == scores[j] else abs(disc[i] - disc[j])) / ideal
                miss = 1 / (1 + math.exp(scores[i] - scores[j]))
                for k, sign in ((i, 1), (j, -1)):
                    g[k] += sign * w * miss
                    h[k] += w * miss * (1 - miss)
    return g, h


def test_lambdas_equal_pairs(spark):
    rng = random.Random(3)
    for n, steps in ((1, 1), (40, 6), (60, 1000)):
        scores, labels = [rng.randint(0, steps) / 4 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        blocks = sorted(set(scores), key=lambda _: rng.random())
        count = lambda want: np.array([sum(s == b and y is want for s, y in zip(scores, labels, strict=True)) for b in blocks])  # noqa: E731, B023
        g1, g0, h1, h0 = G.lambdas(np.array(blocks), count(True), count(False))
        if not any(labels):
            assert not g1.any() and not g0.any()
            continue
        g, h = plain_lambdas(scores, labels)
        for i, (s, y) in enumerate(zip(scores, labels, strict=True)):
            at = blocks.index(s)
            assert math.isclose((g1 if y else g0)[at], g[i], abs_tol=1e-9) and math.isclose((h1 if y else h0)[at], h[i], abs_tol=1e-9)


def test_discounts_beyond_the_table():
    k = np.array([0, 1, 5, (1 << 16) + 1, 300_000])
    assert np.allclose(G.discounts(k), [math.fsum(1 / math.log2(r + 1) for r in range(1, n + 1)) for n in k.tolist()], rtol=1e-6)
    assert np.allclose(G.discounts_by_rank(k), [math.fsum(r / math.log2(r + 1) for r in range(1, n + 1)) for n in k.tolist()], rtol=1e-6)


def test_ranking_trees_raise_ndcg(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(rng.random()), float(rng.random())) for g in range(12) for _ in range(60)]
    rows = [(g, a, b, bool(abs(a - 0.5) + 0.2 * rng.random() < 0.2)) for g, a, b in rows]
    frame = spark.createDataFrame(rows, "g int, a double, b double, y boolean").withColumn("item", F.monotonically_increasing_id()).withColumn("as_of", F.lit(1))
    model = G.ranking_trees(frame, ["a", "b"], "y", "g", trees=5, depth=2)
    scored = model.score(frame, "s")
    assert learning.group_ndcg(scored, "s", "y", "g", 10).first().ndcg > 0.7
    assert learning.group_ndcg(scored, "b", "y", "g", 10).first().ndcg < 0.5


def test_walk_forward_trains_on_no_purged_row(spark):
    rng = np.random.default_rng(9)
    day = [dt.date(2020, 1, 1) + dt.timedelta(int(x)) for x in rng.integers(0, 900, 500)]
    a, b = rng.random(500), [None if rng.random() < 0.1 else float(rng.random()) for _ in range(500)]
    y = [bool(x + 0.3 * rng.random() > 0.6) for x in a]
    frame = spark.createDataFrame([(i, d, float(p), q, t) for i, (d, p, q, t) in enumerate(zip(day, a, b, y, strict=True))], "item long, day date, a double, b double, y boolean")
    folds = WF.even_folds(frame, "day", 5)
    assert len(folds) == 5
    got = {r["item"]: (r.fold, r.score) for r in WF.walk_forward(frame, ["a", "b"], "y", "day", folds, 60).collect()}
    x = np.array([[p, q or 0.0, 0.0, float(q is None)] for p, q in zip(a, b, strict=True)])
    for number, start, stop in folds:
        train = np.array([d < start - dt.timedelta(60) for d in day])
        t, z = x[train], np.array(y, float)[train]
        scale = np.where(t.std(axis=0) > 1e-9, t.std(axis=0), np.inf)
        s = (t - t.mean(axis=0)) / scale
        w = np.linalg.solve(s.T @ s / len(t) + 1e-3 * np.eye(4), s.T @ (z - z.mean()) / len(t))
        test = [i for i, d in enumerate(day) if start <= d < stop]
        assert {i for i, (f, _) in got.items() if f == number} == set(test)
        want = ((x[test] - t.mean(axis=0)) / scale) @ w + z.mean()
        assert np.allclose([got[i][1] for i in test], want, atol=1e-8)


def plain_auc(rows):
    p = [(s, w) for s, y, w in rows if y and w]
    n = [(s, w) for s, y, w in rows if not y and w]
    total = sum(w for _, w in p) * sum(w for _, w in n)
    return sum(a * b * ((s > t) + (s == t) / 2) for s, a in p for t, b in n) / total if total else None


def test_bootstrap_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 12), rng.choice([0.0, 0.0, 0.5, rng.random()]), rng.random(), rng.random() < 0.4, rng.choice("ab")) for _ in range(300)]
    frame = spark.createDataFrame(rows, "c int, s double, t double, y boolean, g string")
    hashes = dict(frame.select("c", F.xxhash64("c").alias("h")).distinct().collect())
    weights = dict(zip(hashes, E.replicate_weights(np.array(list(hashes.values())), 40), strict=True))
    for by, slices in ((None, [None]), ("g", ["a", "b"])):
        got = {r[0] if by else None: r["aucs"] for r in E.bootstrap_aucs(frame, ["s", "t"], "y", "c", by, 40).collect()}
        for g in slices:
            for i in (0, 1):
                for k in range(40):
                    want = plain_auc([(r[1 + i], r[3], weights[r[0]][k]) for r in rows if g is None or r[4] == g])
                    assert (got[g][i][k] is None) == (want is None) and (want is None or math.isclose(got[g][i][k], want, abs_tol=1e-12))
    assert abs(np.mean(np.stack(list(weights.values()))) - 1) < 0.1


def test_models_on_held_out_items(spark):
    row = learning.calibrated_classifier(spark, "/root/testdata/sf0.01").first()
    assert row.falls == 0 and row.calibrated_error < row.raw_error
    loss = {r.model: r.pinball for r in learning.boosted_quantiles(spark, "/root/testdata/sf0.01").collect()}
    assert loss["trees"] < loss["line"] < loss["constant"]
    ndcg = {r.model: r.ndcg for r in learning.listwise_ranker(spark, "/root/testdata/sf0.01").collect()}
    assert ndcg["listwise"] > ndcg["classifier"]
    folds = learning.walk_forward(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.fold for r in folds) == [1, 2, 3, 4, 5]
    assert all(r.low <= r.auc <= r.high for r in folds if r.auc is not None and r.low is not None)


def test_models_read_the_lines_once(spark, monkeypatch, tmp_path):
    """Passes of a fit go over saved rows: what is fitted and scored doesn't read the line items again."""
    from tidemill.operators import train
    from tidemill.plans import evaluation

    seen = []
    monkeypatch.setattr(train, "fit_classifier", lambda rows, *a, **k: seen.append(rows))
    monkeypatch.setattr(train, "quantile_line", lambda rows, features, *a: seen.append(rows) or [0.0] * (len(features) + 1))
    monkeypatch.setattr(train, "probabilities", lambda model, rows, features: seen.append(rows) or rows.withColumn("probability", F.lit(0.5)))
    for query in (evaluation.trained_ranker, evaluation.trained_trees, evaluation.trained_calibration, evaluation.quantile_fit):
        query(spark, "/root/testdata/sf0.001")
    assert len(seen) == 7 and not [rows for rows in seen if any("lineitem" in f for f in rows.inputFiles())]


def test_levels_sum_counts_of_bins(spark, monkeypatch):
    """The levels of a tree go over a row for each combination of bins, not over the rows."""
    frame = spark.range(3000).select((F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"), (F.col("id") * 7 % 100).cast("double").alias("y"))
    seen, grow = [], G.grow
    monkeypatch.setattr(G, "grow", lambda rows, g, h, *a: seen.append(rows.agg(F.count("*"), F.sum(h)).first()) or grow(rows, g, h, *a))
    G.quantile_trees(frame, ["a", "b"], "y", 0.2, trees=2, depth=2)
    assert [tuple(r) for r in seen] == [(6, 3000), (6, 3000)]


def test_quantile_line_over_several_tasks(spark):
    from tidemill.operators import train

    rng = np.random.default_rng(4)
    x = rng.random((900, 2))
    y = 3 * x[:, 0] - x[:, 1] + 5 + rng.exponential(1, 900)
    frame = spark.createDataFrame([(float(p), None if i % 50 == 0 else float(q), float(t)) for i, ((p, q), t) in enumerate(zip(x, y, strict=True))], "a double, b double, y double")
    a, b, rest = train.quantile_line(frame.repartition(5), ["a", "b"], "y", 0.2)
    kept = np.arange(900) % 50 != 0
    below = (y < a * x[:, 0] + b * x[:, 1] + rest)[kept].mean()
    assert abs(below - 0.2) < 0.01 and abs(a - 3) < 0.3 and abs(b + 1) < 0.3
    assert train.quantile_line(frame.where("a < 0"), ["a", "b"], "y", 0.2) == [0.0, 0.0, 0.0]
