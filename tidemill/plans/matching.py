"""Queries that parse titles and match deals to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import parse as P
from tidemill.functions.rounding import rounded
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import matching as M
from tidemill.plans.tables import read
from tidemill.sources.folders import spread

SHOPS = ["Mart", "Best Mart", "Shop"]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as deal titles with packs, sizes and prices."""
    k = F.col("p_partkey")
    pack = F.when(k % 4 == 0, F.concat(F.lit(" Pack of "), (k % 7).cast("string"))).when(k % 4 == 1, F.concat((k % 5).cast("string"), F.lit("-pack")).substr(1, 30)).otherwise(F.lit(""))
    pack = F.when(k % 4 == 1, F.concat(F.lit(", "), (k % 5).cast("string"), F.lit("-pack"))).otherwise(pack)
    size = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" oz"))).when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 Fl. Oz"))).otherwise(F.lit(""))
    cents = (F.col("p_retailprice") * 100).cast("long")
    now = F.concat(F.lit(" $"), F.floor(cents / 1000).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    before = F.when(k % 5 < 2, F.concat(F.lit(" (was $1,"), (100 + k % 800).cast("string"), F.lit(")"))).when(k % 5 == 2, F.concat(F.lit(" $"), (100 + k % 90).cast("string"))).otherwise(F.lit(""))
    shop = F.when(k % 6 == 0, " at Best Mart").when(k % 6 == 1, " at mart").when(k % 6 == 2, " SHOP").otherwise("")
    price = F.when(k % 9 > 0, F.concat(now, before)).otherwise(F.lit(""))
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(k.alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), size, pack, price, shop).alias("title"), "p_size", "p_retailprice")


_T = """t AS (SELECT p_partkey AS id, p_brand AS brand, p_size, p_brand || ' ' || p_name
  || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_size || ' oz' WHEN 1 THEN ' ' || p_size || '.5 Fl. Oz' ELSE '' END
  || CASE p_partkey % 4 WHEN 0 THEN ' Pack of ' || (p_partkey % 7) WHEN 1 THEN ', ' || (p_partkey % 5) || '-pack' ELSE '' END
  || CASE WHEN p_partkey % 9 > 0 THEN ' $' || (CAST(trunc(p_retailprice * 100) AS BIGINT) // 1000) || '.' || lpad(CAST(CAST(trunc(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')
    || CASE WHEN p_partkey % 5 < 2 THEN ' (was $1,' || (100 + p_partkey % 800) || ')' WHEN p_partkey % 5 = 2 THEN ' $' || (100 + p_partkey % 90) ELSE '' END ELSE '' END
  || CASE p_partkey % 6 WHEN 0 THEN ' at Best Mart' WHEN 1 THEN ' at mart' WHEN 2 THEN ' SHOP' ELSE '' END AS title FROM part)"""


def title_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir).withColumn("a", P.attributes(F.col("title"), F.col("brand")))
    return rows.select("id", "a.core_title", "a.pack", "a.size", "a.unit", P.pack_count(F.col("title")).alias("stated"), P.slug(F.col("title")).alias("slug"))


def feed_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", P.feed_deal(F.col("title"), SHOPS).alias("d")).select("id", "d.*")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", P.secret_kind(F.col("text")).alias("kind"), F.sha2(P.redacted(F.col("text")), 256).alias("masked")).where("kind is not null")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product documents made of parts, parsed back."""
    k = F.col("p_partkey")
    arr = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *[x.cast("string") for x in xs]), F.lit("]"))
    cents = (F.col("p_retailprice") * 10).cast("long")
    payload = F.concat(
        F.lit('{"title":"'), F.col("p_name"), F.lit('","brand":"'), F.col("p_brand"), F.lit('","grams":'), F.when(k % 6 == 0, -1).otherwise(F.col("p_size") * 100).cast("string"),
        F.lit(',"rating":'), (k % 51 - 1).cast("string"), F.lit(',"tree":["Root","'), F.when(k % 2 == 0, "Snacks").otherwise("Misc"), F.lit('"],"stats":{"current":'),
        arr(cents, F.when(k % 3 == 0, F.lit(-1)).otherwise(cents + 5), F.when(k % 2 == 0, F.lit(-1)).otherwise(cents + 9)), F.lit(',"avg90":'), arr(F.lit(-1), cents), F.lit(',"min90":'), arr(F.lit(-1), F.when(k % 7 == 0, F.lit(-1)).otherwise(cents - 7)),
        F.lit(',"drops30":'), F.when(k % 4 == 0, -1).otherwise(k % 90).cast("string"), F.lit(',"drops90":'), (k % 200).cast("string"), F.lit(',"oos":'), arr(k % 30, F.when(k % 5 == 0, F.lit(-1)).otherwise(k % 70)),
        F.when(k % 3 == 0, F.lit(',"holder":"x"')).otherwise(F.lit("")), F.lit("}}"),
    )
    return read(spark, sf_dir, "part").select(k.alias("id"), P.product_snapshot(payload).alias("s")).select("id", "s.*")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility, fees and day parsing over orders."""
    k = F.col("o_orderkey")
    none = F.array().cast("array<struct<reasons:array<string>,links:array<string>>>")
    one = F.array(F.struct(F.array(F.col("o_orderpriority")).alias("reasons"), F.when(k % 3 == 1, F.array(F.lit("apply"))).otherwise(F.array().cast("array<string>")).alias("links")))
    fees = F.array(F.struct(F.lit("Fulfilment x").alias("type"), (k % 9).cast("double").alias("amount")), F.struct(F.lit("ReferralFee").alias("type"), ((k % 7) / 2).alias("amount")))
    e = P.eligibility(F.when(k % 3 == 0, none).otherwise(one))
    f = P.fee_items(fees)
    return read(spark, sf_dir, "orders").select("o_orderkey", e["status"].alias("status"), F.array_join(e["reasons"], ",").alias("reasons"), f["referral"].alias("referral"), f["fulfilment"].alias("fulfilment"), f["total"].alias("total"), P.day_of(k * 100000).alias("day"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a rubric, by language."""
    flags = P.graded(F.col("text"), [["the", "der"], ["licen[sc]ed"], ["token\\s*="]])
    rows = read(spark, sf_dir, "documents").withColumn("f", flags)
    rate = rounded(F.sum(F.aggregate("f", F.lit(0), lambda a, x: a + x.cast("int"))) / (3 * F.count("*")), 4)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.get("f", F.lit(i))).alias(f"c{i}") for i in range(3)], rate.alias("rate"))


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir)
    return rows.select(F.col("id").alias("deal_id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("upc"), P.attributes(F.col("title"), F.col("brand")).alias("attrs"), (F.col("p_retailprice") / 10).alias("price"), ((F.col("id") % 13) / 10).alias("stack"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir)
    other = F.concat(F.col("brand"), F.lit(" "), F.col("name"), F.when(F.col("id") % 5 == 0, F.lit(" Pack of 2")).otherwise(F.lit("")))
    return rows.select(F.col("id").alias("item"), F.array(F.col("id").cast("string")).alias("upcs"), P.attributes(other, F.col("brand")).alias("item_attrs"), F.when(F.col("id") % 8 > 0, F.col("p_retailprice") / 4).alias("item_price"))


def deal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.candidates(_deals(spark, sf_dir), _listed(spark, sf_dir))


def deal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(_deals(spark, sf_dir), _listed(spark, sf_dir))


def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_quality(deal_matches(spark, sf_dir).withColumn("expected", F.col("deal_id") == F.col("item")))


def applied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    deals = _deals(spark, sf_dir)
    k = F.col("deal_id")
    matches = deals.select("deal_id", F.col("deal_id").alias("item"), (k % 100 / 100).alias("confidence"), F.when(k % 5 == 0, "approved").when(k % 5 == 1, "rejected").otherwise("open").alias("review"))
    leads = deals.where("deal_id % 4 > 0").select(k.alias("item"), (k % 60).cast("double").alias("net"), (k % 7 == 0).alias("sourced"))
    return M.apply_matches(matches, deals, leads).select("deal_id", "status", "cost", "profit", "roi")


def brand_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hints(_hint_deals(spark, sf_dir), ["Brand#12", "Brand#34", "blue", "green"], ["green"]).select("hint", "store", "strength", "seen")


def hint_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.seeds(brand_hints(spark, sf_dir), F.lit("2024-01-03").cast("date"))


def _hint_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return titles(spark, sf_dir).select("title", F.when(k % 2 == 0, F.col("brand")).alias("brand"), F.when(k % 9 > 0, F.col("p_retailprice")).alias("price"), F.when(k % 3 == 0, 0.3).otherwise(0.9).alias("confidence"), (k % 50).cast("double").alias("discount"), (k % 4).alias("store"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 2).cast("int")).alias("seen"))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "purchase", 200).otherwise(500)
    return M.source_health(e.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), code.alias("code"), (F.col("user_id") % 2 == 0).alias("fallback")))


def registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return M.validate_registry(p.select(F.when(F.col("p_partkey") % 100 == 0, 1).otherwise(F.col("p_partkey")).cast("int").alias("rank"), (F.col("p_partkey") % 1990).alias("domain"), F.col("p_type").alias("code")), ["STANDARD", "SMALL", "LARGE"])


QUERIES = {
    "title_attributes": title_attributes, "feed_deals": feed_deals, "secrets": secrets, "snapshots": snapshots, "api_answers": answers, "graded_texts": graded,
    "deal_candidates": deal_candidates, "deal_matches": deal_matches, "match_quality": match_quality, "applied_matches": applied_matches, "brand_hints": brand_hints,
    "hint_seeds": hint_seeds, "source_health": source_health, "registry_problems": registry_problems,
}
_PACK = "coalesce(" + ", ".join(f"nullif(greatest(try_cast(nullif(regexp_extract(title, '{p}', 1, 'i'), '') AS INTEGER), 0), 0)" for p in P.PACK_PATTERNS) + ")"
_CORE = "title"
for _p in P.PACK_PATTERNS:
    _CORE = f"regexp_replace({_CORE}, '{_p}', ' ', 'gi')"
_CORE = f"regexp_replace({_CORE}, '{P.SIZE_PATTERN}', ' ', 'gi')"
_CORE = f"trim(regexp_replace(regexp_replace(replace({_CORE}, brand, ' '), '[,\\-|]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SECRET = r"(?i)\b(api[_-]?key|apikey|key|token|access[_-]?token|secret)(\s*=\s*[\"'']?)([^&\s\"''<>{}()\[\]]+)"
_HINTS = f"""{_T}, d AS (SELECT title, CASE WHEN id % 2 = 0 THEN lower(brand) ELSE '' END AS f, id % 50 AS discount, id % 4 AS store, DATE '2024-01-01' + CAST(id % 2 AS INTEGER) AS seen FROM t WHERE id % 9 > 0 AND id % 3 > 0),
  h AS (SELECT *, CASE WHEN f IN ('brand#12', 'brand#34') THEN f WHEN contains(title, 'Brand#12') THEN 'brand#12' WHEN contains(title, 'Brand#34') THEN 'brand#34' WHEN regexp_matches(lower(title), '\\bblue\\b') THEN 'blue' WHEN regexp_matches(lower(title), '\\bgreen\\b') THEN 'green' END AS hint FROM d),
  g AS (SELECT hint, store, CAST(sum(CASE WHEN discount >= 25 THEN 1.5 ELSE 1 END) AS DOUBLE) AS strength, max(seen) AS seen FROM h WHERE hint IS NOT NULL AND hint <> 'green' GROUP BY 1, 2)"""
_CENTS = "CAST(trunc(p_retailprice * 10) AS BIGINT)"
SQL = {
    "title_attributes": f"""WITH {_T}, u AS (SELECT *, nullif(regexp_extract(title, '{P.SIZE_PATTERN}', 2, 'i'), '') AS u FROM t)
      SELECT id, {_CORE} AS core_title, coalesce({_PACK}, 1) AS pack, try_cast(nullif(regexp_extract(title, '{P.SIZE_PATTERN}', 1, 'i'), '') AS DOUBLE) AS size,
        CASE lower(u) WHEN 'oz' THEN 'oz' WHEN 'fl. oz' THEN 'fl_oz' END AS unit, {_PACK} AS stated, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM u""",
    "feed_deals": rf"""WITH {_T}, a AS (SELECT *, regexp_extract_all(title, '\$(\d[\d,]*\.?\d*)', 1) AS p, nullif(regexp_extract(title, '(?:reg\.?|regularly|originally|was|list)\s*:?\s*\$?(\d[\d,]*\.?\d*)', 1, 'i'), '') AS o FROM t),
      b AS (SELECT id, CAST(replace(p[1], ',', '') AS DOUBLE) AS c, CAST(replace(coalesce(o, p[2]), ',', '') AS DOUBLE) AS o, CASE WHEN contains(lower(title), 'best mart') THEN 'Best Mart' WHEN contains(lower(title), 'mart') THEN 'Mart' WHEN contains(lower(title), 'shop') THEN 'Shop' ELSE 'unknown' END AS retailer FROM a)
      SELECT id, retailer, c AS price_current, o AS price_original, CASE WHEN o > 0 THEN {r("(1 - c / o) * 100", 1)} END AS discount_pct,
        {r("CASE WHEN c IS NOT NULL AND o IS NOT NULL THEN 0.9::DOUBLE WHEN c IS NOT NULL THEN 0.75 ELSE 0.3 END * CASE WHEN retailer = 'unknown' THEN 0.8::DOUBLE ELSE 1 END", 3)} AS confidence FROM b""",
    "secrets": f"""SELECT doc_id, 'parameter' AS kind, sha256(regexp_replace(text, '{_SECRET}', '\\1\\2***', 'g')) AS masked FROM documents WHERE regexp_matches(text, '{_SECRET}')""",
    "snapshots": f"""WITH k AS (SELECT *, p_partkey AS k, {_CENTS} AS c FROM part)
      SELECT k AS id, p_name AS title, p_brand AS brand, CAST(CASE WHEN k % 2 > 0 THEN c + 9 WHEN k % 3 > 0 THEN c + 5 ELSE c END AS DOUBLE) / 100 AS price, c / 100 AS avg_price_90, CASE WHEN k % 7 > 0 THEN (c - 7) / 100 END AS price_low_90,
        CASE WHEN k % 6 > 0 THEN {r("p_size * 100 / 453.592", 3)} END AS weight_lb, CASE WHEN k % 51 > 0 THEN (k % 51 - 1) / 10 END AS rating, CAST(CASE WHEN k % 4 > 0 THEN k % 90 ELSE round(CAST((k % 200) / 3 AS DECIMAL(18,6)), 0) END AS DOUBLE) AS est_sales,
        CASE WHEN k % 5 > 0 THEN k % 70 ELSE k % 30 END AS oos_90, k % 3 = 0 AS has_buybox, CASE WHEN k % 2 = 0 THEN 'grocery' ELSE 'Root' END AS category FROM k""",
    "api_answers": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ALLOWED' WHEN 1 THEN 'APPROVAL_REQUIRED' ELSE 'NOT_ELIGIBLE' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS reasons,
      (o_orderkey % 7) / 2 AS referral, CAST(o_orderkey % 9 AS DOUBLE) AS fulfilment, o_orderkey % 9 + (o_orderkey % 7) / 2 AS total, CASE WHEN o_orderkey * 100000 BETWEEN 946684800 AND 4102444800 THEN DATE '1970-01-01' + CAST(o_orderkey * 100000 // 86400 AS INTEGER) END AS day FROM orders""",
    "graded_texts": rf"""WITH g AS (SELECT lang, regexp_matches(text, 'the|der', 'i') AS a, regexp_matches(text, 'licen[sc]ed', 'i') AS b, regexp_matches(text, 'token\s*=', 'i') AS c FROM documents)
      SELECT lang, count(*) AS n, count(*) FILTER (WHERE a) AS c0, count(*) FILTER (WHERE b) AS c1, count(*) FILTER (WHERE c) AS c2, {r("sum(CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER)) / (3 * count(*))", 4)} AS rate FROM g GROUP BY 1""",
    "deal_candidates": f"""WITH {_T}, c AS (SELECT id, lower(brand) AS b, lower({_CORE}) AS w FROM t), n AS (SELECT p_partkey AS id, lower(p_brand) AS b, lower(p_name) AS w FROM part),
      x AS (SELECT id, b, unnest(list_filter(list_distinct(string_split(w, ' ')), lambda y: length(y) > 1)) AS w FROM c WHERE id % 2 = 1), y AS (SELECT id, b, unnest(list_filter(list_distinct(string_split(w, ' ')), lambda y: length(y) > 1)) AS w FROM n),
      m AS (SELECT x.id AS deal_id, y.id AS item, CAST(count(*) AS INTEGER) AS overlap FROM x JOIN y USING (b, w) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY overlap DESC, item) AS k FROM m)
      SELECT deal_id, item, false AS by_code, overlap FROM k WHERE k <= 5 UNION ALL SELECT id, id, true, 99 FROM t WHERE id % 2 = 0""",
    "applied_matches": f"""WITH d AS (SELECT p_partkey AS k, p_retailprice / 10 AS price, (p_partkey % 13) / 10 AS stack FROM part),
      s AS (SELECT *, CASE WHEN k % 5 = 1 THEN 'rejected' WHEN NOT (k % 5 = 0 OR k % 100 / 100 >= 0.90) THEN 'unverified' WHEN k % 4 = 0 THEN 'no lead' WHEN k % 7 = 0 THEN 'already sourced' ELSE 'applied' END AS status FROM d),
      c AS (SELECT *, CASE WHEN status = 'applied' THEN {r("price * (1 - greatest(0, least(stack, 0.95)))", 2)} END AS cost FROM s)
      SELECT k AS deal_id, status, cost, {r("k % 60 - cost", 2)} AS profit, {r("(k % 60 - cost) / cost", 3)} AS roi FROM c""",
    "brand_hints": f"WITH {_HINTS} SELECT * FROM g",
    "hint_seeds": f"WITH {_HINTS} SELECT hint AS brand, max(strength) AS strength FROM g WHERE strength >= 2 AND DATE '2024-01-03' - seen <= 3 GROUP BY 1",
    "source_health": """WITH e AS (SELECT user_id, event_id, event_type, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
      c AS (SELECT user_id, g, count(*) FILTER (WHERE event_type = 'error') AS n FROM e GROUP BY 1, 2)
      SELECT CAST(user_id AS VARCHAR) AS url, CAST(arg_max(n, g) AS INTEGER) AS refused, CASE WHEN max(n) >= 2 AND user_id % 2 = 0 THEN 'retired' WHEN arg_max(n, g) > 0 THEN 'failing' ELSE 'ok' END AS state FROM c GROUP BY user_id""",
    "registry_problems": """WITH e AS (SELECT CASE WHEN p_partkey % 100 = 0 THEN 1 ELSE p_partkey END AS rank, p_partkey % 1990 AS domain, p_type AS code FROM part)
      SELECT 'missing rank' AS problem, CAST(i AS VARCHAR) AS value FROM (SELECT unnest(range(1, (SELECT count(*) FROM part) + 1)) AS i) WHERE i NOT IN (SELECT rank FROM e)
      UNION ALL SELECT 'repeated rank', CAST(rank AS VARCHAR) FROM e GROUP BY rank HAVING count(*) > 1 UNION ALL SELECT 'repeated domain', CAST(domain AS VARCHAR) FROM e GROUP BY domain HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'unknown code', code FROM e WHERE code NOT IN ('STANDARD', 'SMALL', 'LARGE')""",
}
