"""Market tables derived from the stock tables: price histories, a catalogue, leads. Each has the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.rounding import rounded, sql_rounded
from tidemill.sources.folders import spread

#: Line items that a task takes where they are dealt by item, and how many there are at least if that leaves cores idle.
LINES_A_TASK, LEAST_LINES = 500_000, 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sum_of_cents(value: str, where: Column) -> Column:
    """The sum of a double column as decimal(18,2), exactly, as a double. Whole cents are summed as integers, which takes
    less than half the time of decimals; other numbers, and those from a thousand million, are summed as decimals."""
    x, cents = F.col(value), F.rint(F.col(value) * 100)
    plain = (cents / 100 == x) & (F.abs(x) < 1e9)
    whole, rest = F.sum(F.when(where & plain, cents.cast("long"))), F.sum(F.when(where & ~plain, x.cast("decimal(18,2)")))
    both = F.coalesce(whole, F.lit(0)).cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)") + rest
    return F.when(rest.isNull(), whole / 100).otherwise(both.cast("double"))


def history(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    """``item, day, price, offers, sales_rank``: one point a day and supplier; returned lines leave the price unknown.

    An item has few lines a day, so summing them ahead of the shuffle saves little. ``by_item`` deals the lines by item:
    the points of an item are made in one task, and what then goes over whole items needs no further shuffle."""
    lines = read(spark, sf_dir, "lineitem").withColumn("item", F.col("l_suppkey").cast("string"))
    if by_item:
        lines = spread(lines, "item", LINES_A_TASK, LEAST_LINES)
    sold = F.col("l_returnflag") != "R"
    return lines.groupBy("item", F.to_date("l_shipdate").alias("day")).agg(
        rounded(_sum_of_cents("l_extendedprice", sold) / _sum_of_cents("l_quantity", sold) / 20, 2).alias("price"),
        F.count("*").alias("offers"),
        (F.sum("l_partkey") % 100000 + 1).alias("sales_rank"),
    )


HISTORY_SQL = f"""history AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS item, CAST(l_shipdate AS DATE) AS day,
    {sql_rounded("CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) / CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) / 20", 2)} AS price,
    count(*) AS offers, CAST(sum(l_partkey) % 100000 + 1 AS BIGINT) AS sales_rank
  FROM lineitem GROUP BY 1, 2)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, brand, category, weight_lb`` of each supplier."""
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("item"),
        F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("brand"),
        F.when(F.col("s_nationkey") % 5 == 0, "grocery").otherwise(F.concat(F.lit("cat"), F.col("s_nationkey") % 5)).alias("category"),
        ((F.col("s_suppkey") % 8) / 2).alias("weight_lb"),
    )


ITEMS_SQL = """items AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS item, 'Brand#' || s_nationkey AS brand,
    CASE WHEN s_nationkey % 5 = 0 THEN 'grocery' ELSE 'cat' || (s_nationkey % 5) END AS category, (s_suppkey % 8) / 2 AS weight_lb
  FROM supplier)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product with its market facts for each part that was sold."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.countDistinct("l_suppkey").alias("offers"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("est_sales"),
        rounded(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / 20, 2).alias("avg_price_90"),
        F.count("*").alias("n_lines"),
        F.min("l_shipdate").cast("date").alias("first_day"),
    )
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").join(lines, F.col("l_partkey") == key).select(
        key.cast("string").alias("item"),
        F.col("p_name").alias("title"),
        F.when(key % 17 == 0, "Generic").when(key % 13 == 0, "LEGO").when(key % 19 == 0, "Nike").otherwise(F.col("p_brand")).alias("brand"),
        F.when(key % 6 == 0, "grocery").otherwise(F.lower("p_type")).alias("category"),
        F.when(key % 23 != 0, rounded(F.col("p_retailprice") * (1 + key % 40) / 400, 2)).alias("price"),
        F.when(key % 11 != 0, F.col("p_size") / 10).alias("weight_lb"),
        F.when(key % 29 != 0, F.col("offers")).alias("offers"),
        F.col("est_sales"),
        (key * 997 % 300000).alias("sales_rank"),
        F.when(key % 3 == 0, key * 991 % 280000).alias("avg_sales_rank_90"),
        F.col("avg_price_90"),
        ((F.col("n_lines") * 7 + key % 5) / 10).alias("avg_offers_90"),
        F.when(key % 4 == 0, (key % 9) / 20).alias("platform_share"),
        (key % 31 == 0).alias("platform_has_buybox"),
        F.when(key % 7 == 0, F.lit(False)).when(key % 7 < 4, F.lit(True)).alias("has_buybox"),
        F.when(key % 5 == 0, rounded(F.col("p_retailprice") * (1 + key % 40) / 600, 2)).alias("price_low_90"),
        (key % 100).cast("double").alias("oos_90"),
        (key % 1200).alias("reviews"),
        (3.5 + (key % 15) / 10).alias("rating"),
        F.col("first_day"),
    )


CATALOGUE_SQL = f"""sold AS (
  SELECT l_partkey, count(DISTINCT l_suppkey) AS offers, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS est_sales,
    {sql_rounded("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 20", 2)} AS avg_price_90,
    count(*) AS n_lines, CAST(min(l_shipdate) AS DATE) AS first_day FROM lineitem GROUP BY 1),
catalogue AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item, p_name AS title,
    CASE WHEN p_partkey % 17 = 0 THEN 'Generic' WHEN p_partkey % 13 = 0 THEN 'LEGO' WHEN p_partkey % 19 = 0 THEN 'Nike' ELSE p_brand END AS brand,
    CASE WHEN p_partkey % 6 = 0 THEN 'grocery' ELSE lower(p_type) END AS category,
    CASE WHEN p_partkey % 23 <> 0 THEN {sql_rounded("p_retailprice * (1 + p_partkey % 40) / 400", 2)} END AS price,
    CASE WHEN p_partkey % 11 <> 0 THEN p_size / 10 END AS weight_lb,
    CASE WHEN p_partkey % 29 <> 0 THEN offers END AS offers, est_sales,
    p_partkey * 997 % 300000 AS sales_rank, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 991 % 280000 END AS avg_sales_rank_90,
    avg_price_90, (n_lines * 7 + p_partkey % 5) / 10 AS avg_offers_90,
    CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 9) / 20 END AS platform_share, p_partkey % 31 = 0 AS platform_has_buybox,
    CASE WHEN p_partkey % 7 = 0 THEN false WHEN p_partkey % 7 < 4 THEN true END AS has_buybox,
    CASE WHEN p_partkey % 5 = 0 THEN {sql_rounded("p_retailprice * (1 + p_partkey % 40) / 600", 2)} END AS price_low_90,
    CAST(p_partkey % 100 AS DOUBLE) AS oos_90, p_partkey % 1200 AS reviews, CAST(3.5 + (p_partkey % 15) / 10 AS DOUBLE) AS rating, first_day
  FROM part JOIN sold ON l_partkey = p_partkey)"""


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leads: ``id, item, brand, created, status, cost, decision, would_rebuy, profit, price_tanked, closed``."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").cast("string").alias("item"),
        F.concat(F.lit("Brand#"), F.col("o_custkey") % 40).alias("brand"),
        F.to_date("o_orderdate").alias("created"),
        F.col("o_orderpriority").alias("category"),
        F.when(key % 3 == 0, "buy").when(key % 3 == 1, "pass").otherwise("defer").alias("decision"),
        F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice").cast("decimal(18,2)") / 1000, 2).cast("double").alias("cost"),
        F.when(F.col("o_orderstatus") != "P", F.round((F.col("o_totalprice").cast("decimal(18,2)") % 5000) / 1000 - 1, 2).cast("double")).alias("profit"),
        F.when(key % 5 == 0, F.lit(True)).when(key % 5 == 1, F.lit(False)).alias("would_rebuy"),
        (key % 9 == 0).alias("price_tanked"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), (key % 60).cast("int"))).alias("closed"),
    )


LEADS_SQL = """leads AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS item, 'Brand#' || (o_custkey % 40) AS brand, CAST(o_orderdate AS DATE) AS created,
    o_orderpriority AS category, CASE o_orderkey % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'pass' ELSE 'defer' END AS decision, o_orderstatus AS status,
    CAST(round(CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 1000 AS DECIMAL(18,6)), 2) AS DOUBLE) AS cost,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(round(CAST((CAST(o_totalprice AS DECIMAL(18,2)) % 5000) / 1000 - 1 AS DECIMAL(18,6)), 2) AS DOUBLE) END AS profit,
    CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS would_rebuy, o_orderkey % 9 = 0 AS price_tanked,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS closed
  FROM orders)"""
