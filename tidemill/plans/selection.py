"""Queries that select, rank and route, and calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scoring as S
from tidemill.functions.rounding import rounded
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import calendar as C
from tidemill.operators import select as R
from tidemill.operators.score import scored
from tidemill.plans.scoring import _SCORED, _STRESSED
from tidemill.plans.tables import CATALOGUE_SQL, LEADS_SQL, catalogue, leads, read


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.discover(catalogue(spark, sf_dir), 50).select("item", "price", "est_sales")


def daily_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(catalogue(spark, sf_dir))
    picked = rows.where(F.col("item").cast("long") % 3 == 0).select("item")
    rank = S.triage_score(F.col("price"), F.col("weight_lb"), F.col("est_sales"), F.col("category"))
    return R.new_winners(rows, picked, 25, threshold=40.0, rank=F.coalesce(F.when(F.col("profit") > 0, rank), F.col("score"))).select("item", "score", "rank_key")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.route(scored(catalogue(spark, sf_dir)), (F.col("reviews") % 100) / 100)
    return rows.groupBy("lane").agg(F.count("*").alias("n"), rounded(F.sum(F.col("score").cast("decimal(18,1)")).cast("double"), 1).alias("score_sum"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_leads = leads(spark, sf_dir)
    rows = all_leads.select("id", F.coalesce("profit", F.lit(0.0)).alias("profit"), (F.col("id") % 50).alias("sales"))
    matches = all_leads.where("id % 7 = 0").select("id", F.when(F.col("id") % 2 == 0, "pending").otherwise("done").alias("status"), ((F.col("id") % 100) / 100).alias("confidence"))
    return R.review_queue(rows, all_leads.where("decision <> 'defer'"), matches)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.brand_history(leads(spark, sf_dir))


def active_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.active_brands(leads(spark, sf_dir), F.lit("2001-07-25").cast("date"))


def recent_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    a = rows.select("brand", F.col("created").alias("seen"))
    b = rows.where("closed is not null").select(F.upper("brand").alias("brand"), F.col("closed").alias("seen"))
    return R.recent_brands(a, b, limit=20)


def due_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = leads(spark, sf_dir).groupBy("brand").agg(F.max("closed").alias("last_run"), F.when(F.max("id") % 2 == 0, 30).alias("every"))
    return R.due(runs, F.lit("2001-09-10").cast("date"), F.col("every")).select("brand", "last_run")


def top_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, F.col("profit")).alias("triage"), F.when(F.col("id") % 3 == 0, F.col("cost") / 100).alias("approx"))
    return R.top_by_triage(rows, 30).select("id", "rank_key")


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, rank, drop = R.axes(F.col("p_partkey") % 60, [3, 4, 5])
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", R.rotation_day(F.col("p_name")).alias("weekday"), price.alias("a"), rank.alias("b"), drop.alias("c"))


def search_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 300).alias("combo"), (F.col("o_orderkey") % 3).alias("pages"), F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderkey") % 2).otherwise(0).alias("items"))
    return R.yields(runs, ["o_orderpriority", "combo"])


def seller_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("seller"), F.col("event_id").alias("pos"))
    return R.recent_pool(seen, "7", 50)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    near = C.nearest_holiday(days, C.holidays(spark, 1994, 2002))
    day = F.col("as_of")
    return near.select(
        "as_of", "days_to_holiday", "holiday",
        C.days_to_window(day, (7, 8), (7, 11)).alias("to_summer_sale"),
        C.weeks_to_deadline(day, (10, 15)).alias("weeks_to_q4"),
        day.between(F.make_date(F.year(day), F.lit(7), F.lit(1)), F.make_date(F.year(day), F.lit(9), F.lit(5))).alias("school"),
        F.weekday(day).alias("weekday"),
        F.array_join(C.season_chips(day), ",").alias("chips"),
    )


_RULES = ", ".join(f"('{n}', '{k}', {m}, {i}, {w})" for n, k, m, i, w in C.HOLIDAYS)
_CALENDAR = f"""WITH rules(name, kind, month, n, wd) AS (VALUES {_RULES}),
ym AS (SELECT *, make_date(y, month, 1) AS s FROM rules, (SELECT unnest(range(1994, 2003)) AS y)),
calc AS (SELECT *, s + CAST((wd - (isodow(s) - 1) + 7) % 7 AS INTEGER) AS f1, last_day(s) AS e FROM ym),
dim AS (SELECT name, CASE kind WHEN 'fixed' THEN s + CAST(n - 1 AS INTEGER) WHEN 'nth' THEN f1 + CAST((n - 1) * 7 AS INTEGER)
  WHEN 'last' THEN e - CAST((isodow(e) - 1 - wd + 7) % 7 AS INTEGER) ELSE f1 + CAST((n - 1) * 7 + 1 AS INTEGER) END AS h FROM calc),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders),
near AS (SELECT as_of, arg_min(struct_pack(h := h, name := name), (abs(h - as_of), h)) AS b FROM days, dim GROUP BY 1),
w AS (SELECT *, CAST(make_date(year(as_of) + CASE WHEN as_of > make_date(year(as_of), 10, 15) THEN 1 ELSE 0 END, 10, 15) - as_of AS INTEGER) AS q4 FROM near)
SELECT as_of, CAST(b.h - as_of AS INTEGER) AS days_to_holiday, b.name AS holiday,
  CAST(make_date(year(as_of) + CASE WHEN as_of > make_date(year(as_of), 7, 11) THEN 1 ELSE 0 END, 7, 8) - as_of AS INTEGER) AS to_summer_sale,
  {r("q4 / 7", 1)} AS weeks_to_q4, as_of BETWEEN make_date(year(as_of), 7, 1) AND make_date(year(as_of), 9, 5) AS school, CAST(isodow(as_of) - 1 AS INTEGER) AS weekday,
  concat_ws(',', CASE WHEN month(as_of) IN (7, 8) THEN 'back-to-school' END, CASE WHEN week(as_of) >= 40 THEN 'q4' END, CASE WHEN q4 BETWEEN 0 AND 45 THEN 'q4-inbound' END,
    CASE WHEN month(as_of) = 1 THEN 'clearance' END, CASE WHEN month(as_of) BETWEEN 3 AND 5 THEN 'spring' END) AS chips
FROM w"""
_MD5 = "md5(p_name)"
_HALF = lambda i: f"CAST('0x' || substr({_MD5}, {i}, 8) AS BIGINT)"
_DAY = f"(((({_HALF(1)} % 7 * {(1 << 32) % 7} + {_HALF(9)}) % 7) * {(1 << 32) % 7} + {_HALF(17)}) % 7 * {(1 << 32) % 7} + {_HALF(25)}) % 7"



_WINNERS = f"""WITH {_SCORED}, keyed AS (SELECT *, coalesce(CASE WHEN profit > 0 THEN {r(f"{r(_STRESSED, 2)} * est_sales / (price * 0.9 * 0.5)", 3)} END, score) AS rank_key FROM judged)
SELECT item, score, rank_key FROM keyed WHERE hard_reject IS NULL AND score >= 40 AND CAST(item AS BIGINT) % 3 <> 0 ORDER BY rank_key DESC NULLS LAST, item LIMIT 25"""

QUERIES = {
    "discovery": discovery,
    "daily_winners": daily_winners,
    "routed": routed,
    "review_queue": review_queue,
    "brand_history": brands,
    "active_brands": active_brands,
    "recent_brands": recent_brands,
    "due_searches": due_searches,
    "top_triage": top_triage,
    "rotation": rotation,
    "search_yields": search_yields,
    "seller_pool": seller_pool,
    "calendar_features": calendar,
}
SQL = {
    "discovery": f"WITH {CATALOGUE_SQL} SELECT item, price, est_sales FROM catalogue WHERE price BETWEEN 8 AND 60 AND sales_rank <= 200000 AND offers BETWEEN 3 AND 25 AND weight_lb <= 5 AND est_sales >= 50 ORDER BY est_sales DESC, item LIMIT 50",
    "daily_winners": _WINNERS,
    "routed": f"""WITH {_SCORED}, p AS (SELECT *, (reviews % 100) / 100 AS q FROM judged),
      l AS (SELECT *, CASE WHEN hard_reject IS NOT NULL THEN 'reject' WHEN q BETWEEN 0.45 AND 0.65 THEN 'review' WHEN q >= 0.70 THEN 'alert' ELSE 'skip' END AS lane FROM p)
      SELECT lane, count(*) AS n, CAST(sum(CAST(score AS DECIMAL(18,1))) AS DOUBLE) AS score_sum FROM l GROUP BY 1""",
    "review_queue": f"""WITH {LEADS_SQL}, o AS (SELECT id, coalesce(profit, 0) * (id % 50) AS worth FROM leads WHERE decision = 'defer'), e AS (SELECT min(worth) AS lo, max(worth) AS hi FROM o)
      SELECT 'lead' AS kind, CAST(id AS VARCHAR) AS ref, {r("(worth - lo) / (hi - lo)", 4)} AS priority FROM o, e
      UNION ALL SELECT 'match', CAST(id AS VARCHAR), {r("1 - (id % 100) / 100", 4)} FROM leads WHERE id % 7 = 0 AND id % 2 = 0""",
    "brand_history": f"""WITH {LEADS_SQL} SELECT lower(brand) AS brand, count(*) AS leads, count(*) FILTER (WHERE decision = 'buy') AS buy, count(*) FILTER (WHERE decision = 'pass') AS pass,
      count(*) FILTER (WHERE decision = 'defer') AS defer, count(closed) AS outcomes, count(*) FILTER (WHERE profit > 0) AS wins FROM leads GROUP BY 1""",
    "active_brands": f"WITH {LEADS_SQL} SELECT DISTINCT brand FROM leads WHERE created >= DATE '2001-07-25' OR closed >= DATE '2001-07-25'",
    "recent_brands": f"""WITH {LEADS_SQL}, u AS (SELECT brand, created AS seen, 0 AS t FROM leads UNION ALL SELECT upper(brand), closed, 1 FROM leads WHERE closed IS NOT NULL),
      k AS (SELECT *, lower(brand) AS key, row_number() OVER (PARTITION BY lower(brand) ORDER BY seen DESC, t, brand DESC) AS rn FROM u)
      SELECT key, brand, seen FROM k WHERE rn = 1 ORDER BY seen DESC, key LIMIT 20""",
    "due_searches": f"""WITH {LEADS_SQL}, s AS (SELECT brand, max(closed) AS last_run, CASE WHEN max(id) % 2 = 0 THEN 30 END AS every FROM leads GROUP BY 1)
      SELECT brand, last_run FROM s WHERE last_run IS NULL OR DATE '2001-09-10' - last_run >= coalesce(every, 21)""",
    "top_triage": f"""WITH {LEADS_SQL} SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN profit END, CASE WHEN id % 3 = 0 THEN cost / 100 END) AS rank_key FROM leads ORDER BY rank_key DESC NULLS LAST, id LIMIT 30""",
    "rotation": f"SELECT p_partkey, CAST({_DAY} AS BIGINT) AS weekday, (p_partkey % 60) // 20 % 3 AS a, (p_partkey % 60) // 5 % 4 AS b, p_partkey % 60 % 5 AS c FROM part",
    "search_yields": """WITH s AS (SELECT o_orderpriority, o_custkey % 300 AS combo, o_orderkey % 3 AS pages, CASE WHEN o_custkey % 7 = 0 THEN o_orderkey % 2 ELSE 0 END AS items FROM orders),
      g AS (SELECT o_orderpriority, combo, count(*) AS runs, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(items) AS BIGINT) AS items FROM s GROUP BY 1, 2)
      SELECT *, runs >= 3 AND pages >= 3 AND items = 0 AS dry FROM g""",
    "seller_pool": "SELECT CAST(user_id AS VARCHAR) AS seller, min(event_id) AS pos FROM events WHERE user_id <> 7 GROUP BY 1 ORDER BY pos DESC LIMIT 50",
    "calendar_features": _CALENDAR,
}
