"""Leakage and boundary cases of the as-of operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import asof, trends
from tidemill.plans import points_in_time, tables

D0 = dt.date(2024, 1, 1)
SCHEMA = "item string, day date, price double, offers long, sales_rank long"


def series(spark, extra=(), days=200):
    rows = [("A", D0 + dt.timedelta(i), 20.0, 5, 15000) for i in range(days)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def probe(spark, day):
    return spark.createDataFrame([("A", day)], "item string, as_of date")


def test_future_points_change_nothing(spark):
    day = D0 + dt.timedelta(100)
    clean = series(spark, days=100)
    poison = [("A", day + dt.timedelta(i), 999999.0, 999, 1) for i in range(0, 40)]
    a = asof.features_as_of(clean, probe(spark, day)).collect()
    b = asof.features_as_of(clean.unionByName(spark.createDataFrame(poison, SCHEMA)), probe(spark, day)).collect()
    assert a == b and a[0].price_as_of == 20.0


def test_same_day_is_not_before(spark):
    rows = spark.createDataFrame([("A", D0, 10.0, 1, 5), ("A", D0 + dt.timedelta(1), 11.0, 2, 4)], SCHEMA)
    got = asof.features_as_of(rows, probe(spark, D0 + dt.timedelta(1))).first()
    assert (got.price_as_of, got.offers_as_of) == (10.0, 1)
    assert asof.features_as_of(rows, probe(spark, D0)).first().price_as_of is None


def test_unknown_price_is_skipped_or_kept_by_rule(spark):
    rows = spark.createDataFrame([("A", D0, 10.0, 1, 9), ("A", D0 + dt.timedelta(3), None, 2, 8)], SCHEMA)
    at = probe(spark, D0 + dt.timedelta(9))
    features = asof.features_as_of(rows, at).first()
    assert features.price_as_of == 10.0 and features.oos_90 == 50.0
    held = asof.values_in_effect(rows, at, ["price"]).first()
    assert held.price_in_effect is None and held.last_point == D0 + dt.timedelta(3)


def test_drops_need_both_points_inside(spark):
    ranks = [(0, 90), (25, 80), (35, 85), (40, 70)]
    rows = spark.createDataFrame([("A", D0 + dt.timedelta(d), 1.0, 1, r) for d, r in ranks], SCHEMA)
    assert asof.features_as_of(rows, probe(spark, D0 + dt.timedelta(50))).first().rank_drops_30 == 1
    assert asof.features_as_of(rows, probe(spark, D0 + dt.timedelta(69))).first().rank_drops_30 is None


def test_label_is_censored_when_tracking_ended(spark):
    day = D0 + dt.timedelta(100)
    got = asof.outcomes_at_horizon(series(spark, days=200), probe(spark, day)).first()
    assert got.price_at_horizon == 20.0
    assert asof.outcomes_at_horizon(series(spark, days=129), probe(spark, day)).count() == 0
    assert asof.outcomes_at_horizon(series(spark, days=131), probe(spark, day)).count() == 1


def test_open_week_does_not_count(spark):
    weeks = [("t", D0 + dt.timedelta(7 * i), 10.0 + i) for i in range(10)] + [("t", D0 + dt.timedelta(70), 999.0)]
    rows = spark.createDataFrame(weeks, "term string, week_start date, interest double")
    asked = spark.createDataFrame([("t", D0 + dt.timedelta(76)), ("t", D0 + dt.timedelta(77)), ("t", D0)], "term string, as_of date")
    got = {r.as_of: r for r in trends.trend_as_of(rows, asked).collect()}
    assert not got[D0 + dt.timedelta(76)].spike and got[D0 + dt.timedelta(76)].slope == 1.0
    assert got[D0 + dt.timedelta(77)].spike
    assert got[D0].ratio is None and got[D0].stale


def test_last_of_day_takes_the_sequence(spark):
    rows = spark.createDataFrame([("A", D0, 1.0, 1), ("A", D0, 2.0, 2)], "item string, day date, price double, seq int")
    assert asof.last_of_day(rows, "seq").first().price == 2.0


@pytest.mark.parametrize("days,n", [(100, 0), (151, 1), (200, 2)])
def test_simulation_dates(spark, days, n):
    assert asof.simulation_dates(series(spark, days=days)).count() == n


def test_closed_weeks(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, False), (None, False), (3.0, None)], "interest double, partial boolean")
    assert sorted(r.interest for r in trends.closed_weeks(rows).collect()) == [2.0, 3.0]
    assert rows.select(F.count("*")).first()[0] == 4


def test_known_and_outcomes_equal_the_two_steps(spark):
    rng = random.Random(6)
    rows = []
    for item in "abcd":
        for day in sorted(rng.sample(range(300), 60)):
            rows.append((item, D0 + dt.timedelta(day), None if rng.random() < 0.4 else float(rng.randint(1, 9)), None if rng.random() < 0.2 else rng.randint(1, 5)))
    points = spark.createDataFrame(rows, "item string, day date, price double, offers long").withColumn("sales_rank", F.lit(1).cast("long"))
    asked = [(item, D0 + dt.timedelta(rng.randint(-5, 320))) for item in "abcde" for _ in range(40)]
    probes = spark.createDataFrame(asked + asked[:9], "item string, as_of date")
    names = ["item", "as_of", "price_as_of", "offers_as_of", "price_at_horizon", "offers_at_horizon"]
    want = asof.features_as_of(points, probes).join(asof.outcomes_at_horizon(points, probes), ["item", "as_of"]).select(*names).collect()
    undated = spark.createDataFrame([("a", None, 77.0, 7, 7)], points.schema)  # a point without a day is never seen
    found = asof.known_and_outcomes(points.unionByName(undated), probes).select(*names)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want), key=repr) and len(want) > 80
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


@pytest.mark.parametrize("step, horizon, history", [(35, 60, 90), (7, 20, 10), (1, 3, 0)])
def test_simulated_outcomes_equal_dates_and_probes(spark, step, horizon, history):
    rng = random.Random(step)
    rows = [("none", D0 + dt.timedelta(i), None, 3) for i in range(0, 400, 50)] + [("one", D0, 4.0, 2), ("short", D0, 1.0, 1), ("short", D0 + dt.timedelta(history + horizon - 1), 1.0, 1)]
    rows += [("edge", D0, 1.0, 1), ("edge", D0 + dt.timedelta(history + horizon), 2.0, None), ("gap", D0 - dt.timedelta(2000), 5.0, 2), ("gap", D0, None, 1), ("gap", D0 + dt.timedelta(900), 6.0, 9), ("gap", D0 + dt.timedelta(1000), None, 9)]
    for item in "abcdef":
        for day in sorted(rng.sample(range(-500, 500), rng.choice([20, 150, 600]))):
            rows.append((item, D0 + dt.timedelta(day), None if rng.random() < 0.4 else float(rng.randint(1, 9)), None if rng.random() < 0.2 else rng.randint(1, 5)))
    points = spark.createDataFrame([*rows, ("a", None, 77.0, 7), (None, D0, 1.0, 1)], "item string, day date, price double, offers long")
    names = ["item", "as_of", "price_as_of", "offers_as_of", "price_at_horizon", "offers_at_horizon"]
    dated = points.where("item is not null")
    want = asof.known_and_outcomes(dated, asof.simulation_dates(dated, step, horizon, history), horizon).select(*names).collect()
    found = asof.simulated_outcomes(points, step, horizon, history).select(*names).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want), key=repr)
    assert {"edge", "gap"} < {r.item for r in found} and not {"none", "one", "short"} & {r.item for r in found}


def test_backtest_rows_shuffle_the_lines_once(spark, monkeypatch):
    """Points, dates and values are made where an item's lines are; nothing is written out or dealt anew."""
    monkeypatch.setattr(tables, "LEAST_LINES", 1)
    found = points_in_time.backtest_rows(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("lineitem.parquet") == 1


def test_cents_are_summed_as_decimals_are(spark):
    values = [0.1, 0.2, 19.99, -3.07, 1.005, 2.675, 1e-9, 123456789.12, 1e9, 9_999_999_999_999.99, -4e15, 0.0, None, float("nan")]
    rng = random.Random(2)
    rows = [(g, rng.choice(values) if g % 3 else round(rng.random() * 1e5, 2), rng.random() < 0.8) for g in range(40) for _ in range(12)]
    frame = spark.createDataFrame([*rows, (90, 1.0, False), (91, None, True)], "g int, x double, y boolean")
    plain = F.sum(F.when(F.col("y"), F.col("x").cast("decimal(18,2)"))).cast("double")
    for r in frame.groupBy("g").agg(tables._sum_of_cents("x", F.col("y")).alias("a"), plain.alias("b")).collect():
        assert r.a == r.b
