"""Queries over the catalogue: economics, scores, gates, flags, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import economics as E
from tidemill.functions import scoring as S
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators.score import scored
from tidemill.plans.points_in_time import FEE
from tidemill.plans.tables import CATALOGUE_SQL, catalogue

BANDED = {"grocery": (15.0, 0.08, 0.15)}
RATES = {"default": 0.15, "promo": 0.12}


def unit_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    price, w, cat = F.col("price"), F.col("weight_lb"), F.col("category")
    profit, roi = E.profit_roi(price, w, cat, rates=RATES, banded=BANDED)
    plain, plain_roi = E.profit_roi(price, w)
    real, real_roi = E.profit_roi_real_fees(price, F.col("price_low_90") / 2, price * 0.13, F.lit(4.1), w)
    return c.select(
        "item",
        F.round(E.fulfilment_fee(w).cast("decimal(18,6)"), 4).cast("double").alias("fulfilment"),
        E.inbound_shipping(w).alias("inbound"),
        profit.alias("profit"), roi.alias("roi"), plain.alias("plain_profit"), plain_roi.alias("plain_roi"),
        real.alias("real_profit"), real_roi.alias("real_roi"),
        E.net_proceeds(price, w, cat, rates=RATES, banded=BANDED).alias("net"),
        E.landed_cost(price).alias("landed_cost"),
        F.round(E.product_margin(price, w).cast("decimal(18,6)"), 4).cast("double").alias("margin"),
        E.contribution_margin(price, F.col("price_low_90") / 2, w).alias("contribution"),
        E.break_even_price(F.col("price_low_90") / 2, w).alias("break_even"),
        E.max_cost(price, w).alias("max_cost"),
    )


W, FEE_W = "coalesce(weight_lb, 1.0)", FEE.replace("w ", "coalesce(weight_lb, 1.0) ")
INBOUND = r(f"{W} * 0.6", 2)
_RATE = "CASE WHEN category = 'grocery' THEN CASE WHEN price <= 15 THEN 0.08 ELSE 0.15 END WHEN category = 'promo' THEN 0.12 ELSE 0.15 END"
_LEFT = f"(price - greatest(price * CAST({_RATE} AS DOUBLE), 0.30) - CAST({FEE_W} AS DOUBLE) * 1.035 - 0.5 - {INBOUND})"
_PLAIN = f"(price - price * 0.15 - CAST({FEE_W} AS DOUBLE) * 1.035 - 0.5 - {INBOUND})"
_REAL = f"(price - price * 0.13 - 4.1 - price_low_90 / 2 - 0.5 - {INBOUND})"
_ECONOMICS = f"""WITH {CATALOGUE_SQL}
SELECT item, {r(f"CAST({FEE_W} AS DOUBLE)", 4)} AS fulfilment, {INBOUND} AS inbound,
  {r(f"{_LEFT} - price * 0.5", 2)} AS profit, {r(f"({_LEFT} - price * 0.5) / (price * 0.5)", 3)} AS roi,
  {r(f"{_PLAIN} - price * 0.5", 2)} AS plain_profit, {r(f"({_PLAIN} - price * 0.5) / (price * 0.5)", 3)} AS plain_roi,
  {r(_REAL, 2)} AS real_profit, {r(f"{_REAL} / (price_low_90 / 2)", 3)} AS real_roi,
  {r(_LEFT, 2)} AS net, {r("price * 0.5", 2)} AS landed_cost,
  {r(f"(price * (1 - 0.15 - 0.30 - 0.10) - CAST({FEE_W} AS DOUBLE) * 1.035) / price", 4)} AS margin,
  {r(f"price - price * 0.15 - CAST({FEE_W} AS DOUBLE) - price_low_90 / 2 - price * 0.10", 2)} AS contribution,
  {r(f"(price_low_90 / 2 + CAST({FEE_W} AS DOUBLE) * 1.035 + 0.5 + {INBOUND}) / 0.85", 2)} AS break_even,
  {r(f"least({r(_PLAIN, 2)} - 3, {r(_PLAIN, 2)} / 1.3)", 2)} AS max_cost
FROM catalogue"""


def resale_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(catalogue(spark, sf_dir)).select(
        "item", "profit", "roi", "base", "score", "hard_reject", "verdict",
        F.array_join(F.transform("adjustments", lambda x: x["name"]), ",").alias("adjusted_by"),
        F.array_join(F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["name"]), ",").alias("failed"),
    )


_PROFIT = f"(price - greatest(price * 0.15, 0.30) - CAST({FEE_W} AS DOUBLE) * 1.035 - 0.5 - {INBOUND} - price * 0.5)"
_LOW = f"(price_low_90 - price_low_90 * 0.15 - CAST({FEE_W} AS DOUBLE) * 1.035 - 0.5 - {INBOUND} - price_low_90 * 0.5)"
_BRAND = "lower(trim(coalesce(brand, '')))"
_STEPS = [  # name, condition, points
    ("friendly-brand", f"{_BRAND} = 'lego'", "5.0"),
    ("avoid-brand", f"{_BRAND} = 'nike'", "0.0"),
    ("preferred-offer-band", "offers BETWEEN 5 AND 7", "5.0"),
    ("price-spike", "price > avg_price_90 * 1.5", "-15.0"),
    ("price-caution", "price / avg_price_90 >= 1.15 AND price / avg_price_90 < 1.5", "-5.0"),
    ("offers-rising", "offers > avg_offers_90 * 1.4", "-12.0"),
    ("platform-shares-buybox", "platform_share > 0 AND NOT platform_has_buybox", "-10.0"),
    ("ip-cliff", "avg_offers_90 >= 8 AND offers <= 2", "-20.0"),
    ("worst-case-loss", f"{r(f'greatest(0, -{r(_LOW, 2)})', 2)} > 2", "-10.0"),
    ("no-featured-offer", "coalesce(NOT has_buybox, false) OR (has_buybox IS NULL AND offers >= 3)", "-8.0"),
    ("generic-brand", f"{_BRAND} = '' OR contains({_BRAND}, 'generic')", "-8.0"),
    ("price-out-of-band", "price NOT BETWEEN 8 AND 60", r("-8.0 * least(1.0, (CASE WHEN price < 8 THEN 8 - price ELSE price - 60 END) / 156.0)", 1)),
]


def _chain() -> str:
    steps, last = [], "based"
    for i, (name, on, points) in enumerate(_STEPS):
        moved = r(f"s + {points}", 1)
        moved = f"least(100.0, {moved})" if not points.startswith("-") and not points.startswith("CAST") else f"greatest(0.0, {moved})"
        steps.append(f"s{i} AS MATERIALIZED (SELECT * EXCLUDE (s, names), CASE WHEN {on} THEN {moved} ELSE s END AS s, CASE WHEN {on} THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"s{i}"
    return ", ".join(steps)


_SCORED = f"""{CATALOGUE_SQL},
gains AS (SELECT *, CASE WHEN price > 0 THEN {r(_PROFIT, 2)} END AS profit, CASE WHEN price > 0 THEN {r(f"{_PROFIT} / (price * 0.5)", 3)} END AS roi,
  coalesce(avg_sales_rank_90, sales_rank) AS rank, CASE WHEN category = 'grocery' THEN 0.25 ELSE 0.30 END AS min_roi FROM catalogue),
based AS (SELECT *, {r('''
  CASE WHEN rank <= 200000 THEN 20.0 ELSE greatest(0.0, 20 * (1 - least((rank - 200000) / 200000, 1.0))) END
  + CASE WHEN est_sales IS NULL THEN 4.5 WHEN est_sales >= 50 THEN 18.0 ELSE greatest(0.0, 18 * est_sales / 50) END
  + CASE WHEN offers IS NULL THEN 4.0 WHEN offers < 3 THEN 4.8 WHEN offers <= 25 THEN 16.0 ELSE greatest(0.0, 16 * (1 - least((offers - 25) / 25 * 0.5, 1.0))) END
  + CASE WHEN roi IS NULL THEN 5.5 WHEN roi >= min_roi THEN 22.0 ELSE greatest(0.0, 22 * roi / min_roi) END
  + CASE WHEN profit IS NULL THEN 3.0 WHEN profit >= 3 THEN 12.0 ELSE greatest(0.0, 12 * profit / 3) END
  + CASE WHEN platform_has_buybox THEN 0.0 ELSE 12.0 END''', 1)} AS base FROM gains),
begun AS (SELECT *, base AS s, CAST([] AS VARCHAR[]) AS names FROM based),
{_chain().replace("FROM based)", "FROM begun)")},
judged AS MATERIALIZED (SELECT *, s AS score, CASE WHEN platform_has_buybox THEN 'platform holds the buy box' WHEN platform_share >= 0.20 THEN 'platform rotates on the buy box'
  WHEN {_BRAND} = 'nike' THEN 'avoided brand' WHEN avg_offers_90 >= 8 AND offers <= 2 THEN 'offers collapsed' WHEN price IS NULL OR price <= 0 THEN 'no price' END AS hard_reject
  FROM s{len(_STEPS) - 1})"""
_SCORES = f"""WITH {_SCORED}
SELECT item, profit, roi, base, score, hard_reject, CASE WHEN hard_reject IS NULL AND score >= 70 THEN 'review' ELSE 'pass' END AS verdict,
  array_to_string(names, ',') AS adjusted_by,
  concat_ws(',', CASE WHEN rank > 200000 THEN 'bsr' END, CASE WHEN est_sales >= 50 THEN NULL ELSE 'sales' END, CASE WHEN offers BETWEEN 3 AND 25 THEN NULL ELSE 'offers' END,
    CASE WHEN roi >= min_roi THEN NULL ELSE 'roi' END, CASE WHEN profit >= 3 THEN NULL ELSE 'profit' END, CASE WHEN platform_has_buybox THEN 'buybox' END) AS failed
FROM judged"""


def product_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, margin = S.product_score(F.col("price"), F.col("est_sales"), F.col("reviews"), F.col("rating"), F.col("weight_lb"), F.col("offers"))
    return catalogue(spark, sf_dir).select("item", score.alias("score"), margin.alias("margin"))


_MARGIN = f"CASE WHEN price > 0 THEN (price * (1 - 0.15 - 0.30 - 0.10) - CAST({FEE_W} AS DOUBLE) * 1.035) / price END"
_PRODUCT = f"""WITH {CATALOGUE_SQL}, m AS (SELECT *, {_MARGIN} AS margin_raw FROM catalogue)
SELECT item, {r('''
  CASE WHEN price IS NULL THEN 4.5 WHEN price BETWEEN 15 AND 50 THEN 18.0 ELSE greatest(0.0, 18 * (1 - least(CASE WHEN price < 15 THEN (15 - price) / 35 ELSE (price - 50) / 35 END, 1.0))) END
  + CASE WHEN est_sales IS NULL THEN 4.5 WHEN est_sales >= 200 THEN 18.0 ELSE 18 * est_sales / 200 END
  + CASE WHEN reviews <= 500 THEN 16.0 ELSE greatest(0.0, 16 * (1 - least((reviews - 500) / 500 * 0.5, 1.0))) END
  + CASE WHEN rating <= 4.3 THEN 12.0 ELSE greatest(0.0, 12 * (1 - least((rating - 4.3) / 4.3 * 0.5, 1.0))) END
  + CASE WHEN weight_lb IS NULL THEN 3.0 WHEN weight_lb <= 1 THEN 12.0 ELSE greatest(0.0, 12 * (1 - least((weight_lb - 1) * 0.5, 1.0))) END
  + CASE WHEN offers IS NULL THEN 2.0 WHEN offers <= 15 THEN 8.0 ELSE greatest(0.0, 8 * (1 - least((offers - 15) / 15 * 0.5, 1.0))) END
  + CASE WHEN margin_raw IS NULL THEN 4.0 WHEN margin_raw >= 0.25 THEN 16.0 ELSE greatest(0.0, 16 * margin_raw / 0.25) END''', 1)} AS score, {r("margin_raw", 4)} AS margin
FROM m"""


def flags_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scored(catalogue(spark, sf_dir))
    return c.select(
        "item",
        F.array_join(S.gate_reasons(), ",").alias("gates"),
        F.array_join(S.risk_flags(), ",").alias("flags"),
        S.restriction_hint(F.col("title"), F.col("brand")).alias("hint"),
        S.worst_case_loss(F.col("price_low_90"), F.col("weight_lb")).alias("worst_case"),
        S.triage_score(F.col("price"), F.col("weight_lb"), F.col("est_sales"), F.col("category")).alias("triage"),
        S.blended(F.col("score"), (F.col("reviews") % 100) / 100, 0.4).alias("blend"),
        S.velocity(F.col("offers"), F.col("oos_90"), F.col("has_buybox")).alias("velocity"),
        F.array_join(S.compliance_terms(F.col("title"), ["blue", "steel", "choc"]), ",").alias("terms"),
    )


_STRESSED = _PROFIT.replace("price ", "(price * 0.9) ").replace("(price -", "((price * 0.9) -")
_WORDS = "|".join(w for words in S.RESTRICTED_WORDS.values() for w in words)
_HINTS = ", ".join(f"CASE WHEN regexp_matches(t, '\\b({'|'.join(words)})\\b') THEN '{kind}' END" for kind, words in S.RESTRICTED_WORDS.items())
_FLAGS = f"""WITH {_SCORED}, worded AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(brand, '')) AS t,
  CASE WHEN price_low_90 > 0 THEN {r(f'greatest(0, -{r(_LOW, 2)})', 2)} END AS worst_case FROM judged)
SELECT item,
  concat_ws(',', CASE WHEN platform_has_buybox THEN 'platform_buybox' END, CASE WHEN offers > 25 THEN 'too_many_offers' END, CASE WHEN weight_lb > 5 THEN 'too_heavy' END,
    CASE WHEN roi < 0.30 THEN 'low_roi' END, CASE WHEN profit < 3 THEN 'low_profit' END, CASE WHEN price IS NULL OR price <= 0 THEN 'no_price' END) AS gates,
  concat_ws(',', CASE WHEN platform_has_buybox THEN 'platform_buybox' END, CASE WHEN platform_share > 0 AND NOT platform_has_buybox THEN 'platform_rotates' END,
    CASE WHEN regexp_matches(t, '\\b({_WORDS})\\b') THEN 'restricted' END, CASE WHEN offers < 3 THEN 'few_sellers' END, CASE WHEN offers > 25 THEN 'crowded' END,
    CASE WHEN price NOT BETWEEN 8 AND 60 THEN 'price_band' END, CASE WHEN sales_rank > 200000 THEN 'slow' END, CASE WHEN est_sales < 50 THEN 'thin_demand' END,
    CASE WHEN roi < 0.30 THEN 'low_roi' END, CASE WHEN profit < 3 THEN 'low_profit' END, CASE WHEN oos_90 > 30 THEN 'stockouts' END,
    CASE WHEN price > avg_price_90 * 1.5 THEN 'price_spike' END, CASE WHEN offers > avg_offers_90 * 1.4 THEN 'offers_rising' END,
    CASE WHEN avg_offers_90 >= 8 AND offers <= 2 THEN 'offer_cliff' END, CASE WHEN worst_case > 2 THEN 'worst_case' END,
    CASE WHEN price IS NULL OR offers IS NULL THEN 'incomplete' END) AS flags,
  nullif(concat_ws(', ', {_HINTS}), '') AS hint, worst_case,
  CASE WHEN price > 0 THEN {r(f"{r(_STRESSED, 2)} * est_sales / (price * 0.9 * 0.5)", 3)} END AS triage,
  {r("0.6 * score + 0.4 * 100 * ((reviews % 100) / 100)", 2)} AS blend,
  {r("coalesce(offers, 0) * (1 - coalesce(oos_90, 0) / 100) + 2 * CAST(coalesce(has_buybox, false) AS INTEGER)", 3)} AS velocity,
  concat_ws(',', CASE WHEN contains(lower(title), 'blue') THEN 'blue' END, CASE WHEN contains(lower(title), 'steel') THEN 'steel' END, CASE WHEN contains(lower(title), 'choc') THEN 'choc' END) AS terms
FROM worded"""

QUERIES = {
    "unit_economics": unit_economics,
    "resale_scores": resale_scores,
    "product_scores": product_scores,
    "flags_and_gates": flags_and_gates,
}
SQL = {"unit_economics": _ECONOMICS, "resale_scores": _SCORES, "product_scores": _PRODUCT, "flags_and_gates": _FLAGS}
