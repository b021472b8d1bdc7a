"""Queries over price histories: simulation dates, as-of features, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import economics as E
from tidemill.functions.once import computed_once
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import asof
from tidemill.plans.tables import HISTORY_SQL, ITEMS_SQL, history, items

DATES_SQL = """ends AS (SELECT item, min(day) + 90 AS a, max(day) - 60 AS b FROM history WHERE price IS NOT NULL GROUP BY 1),
dates AS (SELECT item, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 35 DAY)) AS DATE) AS as_of FROM ends WHERE a <= b)"""


def simulation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.simulation_dates(history(spark, sf_dir))


def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = history(spark, sf_dir)
    return asof.features_as_of(points, asof.simulation_dates(points))


def value_in_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = history(spark, sf_dir)
    return asof.values_in_effect(points, asof.simulation_dates(points), ["price", "offers"])


def backtest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, frozen cost, and the label observed at the horizon, for each item and simulation date. The lines are
    shuffled once, by item; points, dates and values are made of them where they are."""
    rows = asof.simulated_outcomes(history(spark, sf_dir, by_item=True)).where(F.col("price_as_of") > 0)
    rows = rows.join(items(spark, sf_dir), "item")
    left = E.net_proceeds(F.col("price_at_horizon"), F.col("weight_lb"), F.col("category"))
    rows = computed_once(rows, {"landed_cost": E.landed_cost(F.col("price_as_of")), "left": left})
    rows = computed_once(rows, {"est_profit": F.round((F.col("left") - F.col("landed_cost")).cast("decimal(18,6)"), 2).cast("double")})
    rows = rows.withColumn("success", E.consistent_label(F.col("est_profit"), F.col("landed_cost"), F.col("category")))
    return rows.where(F.col("success").isNotNull()).select(
        "item", "as_of", "category", "landed_cost", "price_as_of", "offers_as_of", "price_at_horizon", "offers_at_horizon", "est_profit", "success",
        E.cost_free_target(F.col("est_profit"), F.col("landed_cost"), F.col("price_as_of")).alias("target"),
        E.crashed(F.col("price_as_of"), F.col("price_at_horizon")).alias("crashed"),
        E.swarmed(F.col("offers_as_of"), F.col("offers_at_horizon")).alias("swarmed"),
    )


def success_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest_rows(spark, sf_dir).groupBy(F.year("as_of").alias("year"))
    return rows.agg(F.count("*").alias("n"), F.count_if("success").alias("wins"), F.count_if("crashed").alias("crashes"))


FEE = "(CASE WHEN w <= 0.75 THEN 3.22 WHEN w <= 1.0 THEN 4.65 WHEN w <= 1.5 THEN 5.50 WHEN w <= 2.0 THEN 6.10 WHEN w <= 2.5 THEN 6.63 WHEN w <= 3.0 THEN 6.75 ELSE 6.75 + 0.16 * (w - 3.0) / 0.5 END)"


def net_sql(price: str, weight: str) -> str:
    """Net proceeds with a known category."""
    fee = FEE.replace("w ", f"coalesce({weight}, 1.0) ")
    return f"CASE WHEN {price} > 0 THEN {r(f'{price} - greatest({price} * 0.15, 0.30) - CAST({fee} AS DOUBLE) * 1.035 - 0.5 - {r(f'coalesce({weight}, 1.0) * 0.6', 2)}', 2)} END"


_FEATURES_SQL = f"""feats AS (
  SELECT d.item, d.as_of,
    arg_max(price, day) FILTER (WHERE price IS NOT NULL) AS price_as_of,
    arg_max(offers, day) AS offers_as_of, arg_max(sales_rank, day) AS rank_as_of,
    {r("avg(price) FILTER (WHERE day >= as_of - 90)", 3)} AS avg_price_90, {r("avg(offers) FILTER (WHERE day >= as_of - 90)", 3)} AS avg_offers_90,
    CASE WHEN count(*) FILTER (WHERE day >= as_of - 90) > 0 THEN {r("100 * count(*) FILTER (WHERE day >= as_of - 90 AND price IS NULL) / count(*) FILTER (WHERE day >= as_of - 90)", 1)} END AS oos_90,
    CASE WHEN count(*) FILTER (WHERE day >= as_of - 30) >= 2 THEN count(*) FILTER (WHERE day >= as_of - 30 AND prev_day >= as_of - 30 AND sales_rank < prev_rank) END AS rank_drops_30
  FROM dates d LEFT JOIN (SELECT *, lag(sales_rank) OVER w AS prev_rank, lag(day) OVER w AS prev_day FROM history WINDOW w AS (PARTITION BY item ORDER BY day)) h
    ON h.item = d.item AND h.day < d.as_of
  GROUP BY d.item, d.as_of)"""
_EFFECT_SQL = """effect AS (
  SELECT d.item, d.as_of, arg_max(struct_pack(v := price), day).v AS price_in_effect, arg_max(offers, day) AS offers_in_effect, max(day) AS last_point
  FROM dates d LEFT JOIN history h ON h.item = d.item AND h.day < d.as_of GROUP BY 1, 2)"""
_ROWS_SQL = f"""{HISTORY_SQL}, {DATES_SQL}, {ITEMS_SQL}, {_FEATURES_SQL},
later AS (
  SELECT d.item, d.as_of, arg_max(struct_pack(v := price), day).v AS price_at_horizon, arg_max(offers, day) AS offers_at_horizon
  FROM dates d JOIN history h ON h.item = d.item AND h.day < d.as_of + 61
  WHERE (SELECT max(day) FROM history e WHERE e.item = d.item) >= d.as_of + 30 GROUP BY 1, 2),
joined AS (
  SELECT f.*, price_at_horizon, offers_at_horizon, category, {r("price_as_of * 0.5", 2)} AS landed_cost, {net_sql("price_at_horizon", "weight_lb")} AS net
  FROM feats f JOIN later USING (item, as_of) JOIN items USING (item) WHERE price_as_of > 0),
profits AS (SELECT *, {r("net - landed_cost", 2)} AS est_profit FROM joined),
labelled AS (SELECT *, est_profit >= 3 AND est_profit / landed_cost >= CASE WHEN category = 'grocery' THEN 0.25 ELSE 0.30 END AS success FROM profits WHERE est_profit IS NOT NULL),
backtest AS (
  SELECT item, as_of, category, landed_cost, price_as_of, offers_as_of, price_at_horizon, offers_at_horizon, est_profit, success,
    {r("greatest(least(least(est_profit + landed_cost - 3, (est_profit + landed_cost) / 1.3) / price_as_of, 2), -1)", 4)} AS target,
    price_at_horizon < 0.70 * price_as_of AS crashed, CASE WHEN offers_as_of > 0 THEN offers_at_horizon >= 1.5 * offers_as_of END AS swarmed
  FROM labelled)"""

QUERIES = {
    "simulation_dates": simulation_dates,
    "asof_features": asof_features,
    "value_in_effect": value_in_effect,
    "backtest_rows": backtest_rows,
    "success_by_year": success_by_year,
}
SQL = {
    "simulation_dates": f"WITH {HISTORY_SQL}, {DATES_SQL} SELECT item, as_of FROM dates",
    "asof_features": f"WITH {HISTORY_SQL}, {DATES_SQL}, {_FEATURES_SQL} SELECT * FROM feats",
    "value_in_effect": f"WITH {HISTORY_SQL}, {DATES_SQL}, {_EFFECT_SQL} SELECT * FROM effect",
    "backtest_rows": f"WITH {_ROWS_SQL} SELECT * FROM backtest",
    "success_by_year": f"WITH {_ROWS_SQL} SELECT CAST(year(as_of) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE success) AS wins, count(*) FILTER (WHERE crashed) AS crashes FROM backtest GROUP BY 1",
}
