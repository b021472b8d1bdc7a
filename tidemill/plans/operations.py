"""Queries over the raw lake and operational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.rounding import rounded
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import reports as O
from tidemill.operators.score import scored
from tidemill.plans.scoring import _SCORED
from tidemill.plans.tables import LEADS_SQL, catalogue, leads, read
from tidemill.sources import lake as L


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lake rows: few payload values, so that many rows repeat the one before; some hashes are wrong."""
    e = read(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"v": '), (F.col("event_id") % 3).cast("string"), F.lit("}"))
    hashed = F.when(F.col("event_id") % 41 == 0, F.lit("bad")).otherwise(L.content_hash(payload))
    return e.select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("entity_id"), F.lit("stats").alias("endpoint"), F.col("event_id").alias("fetched_at"), payload.alias("payload"), hashed.alias("content_hash"))


_RAW = """raw AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS entity_id, event_id AS fetched_at, '{"v": ' || (event_id % 3) || '}' AS payload,
  CASE WHEN event_id % 41 = 0 THEN 'bad' ELSE sha256('{"v": ' || (event_id % 3) || '}') END AS content_hash FROM events)"""
_KEPT = """good AS (SELECT *, lag(content_hash) OVER (PARTITION BY source, entity_id ORDER BY fetched_at) AS before FROM raw WHERE sha256(payload) = content_hash),
kept AS (SELECT * FROM good WHERE before IS NULL OR before <> content_hash)"""


def lake_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = L.drain(raw(spark, sf_dir), None)
    return good.select("source", "entity_id", "fetched_at", "content_hash")


def lake_second_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    first, _ = L.drain(rows.where("fetched_at % 2 = 0"), None)
    good, bad = L.drain(rows.where("fetched_at % 2 = 1"), L.manifest_of(first))
    cols = ["source", "entity_id", "fetched_at"]
    return good.select(*cols, F.lit("kept").alias("lane")).unionByName(bad.select(*cols, F.lit("quarantine").alias("lane")))


def lake_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.manifest_of(L.drain(raw(spark, sf_dir), None)[0]).select("source", "entity_id", "content_hash", "last_seen")


def lake_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.integrity(raw(spark, sf_dir))


def lake_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    return L.digest(rows, L.drain(rows, None)[0])


def lake_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return e.select("event_id", L.content_hash(F.col("props")).alias("content"), L.params_hash(params).alias("params"))


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 2 == 0).alias("changed"), F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 10) / 10).alias("confidence"))
    return L.to_archive(rows)


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three write rules over the same rows: merge, first write wins, sightings."""
    rows = leads(spark, sf_dir).select("item", "category", "id", "cost")
    key = ["item", "category"]
    old, new = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    merged = L.upsert(L.upsert(old.limit(0), old, key, "id"), new, key, "id")
    frozen = L.insert_new(L.upsert(old.limit(0), old, key, "id"), new, key, "id")
    empty = old.limit(0).withColumnsRenamed({"id": "first_seen"}).withColumn("last_seen", F.col("first_seen"))
    seen = L.upsert_sightings(L.upsert_sightings(empty, old.withColumnRenamed("id", "seen"), key), new.withColumnRenamed("id", "seen"), key)
    cols = lambda df, rule, first, last: df.select(F.lit(rule).alias("rule"), *key, F.col(first).alias("first_seen"), F.col(last).alias("last_seen"), "cost")
    return cols(merged, "merge", "id", "id").unionByName(cols(frozen, "freeze", "id", "id")).unionByName(cols(seen, "sightings", "first_seen", "last_seen"))


def copies_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select("item", "category", "decision")
    return L.table_drift(rows, leads(spark, sf_dir).where("id % 50 <> 0").select("item", "category", F.when(F.col("id") % 80 == 1, "sold").otherwise(F.col("decision")).alias("decision")))


def sell_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).where("closed is not null")
    return O.sell_through(rows.select((F.col("id") % 6).alias("bought"), (F.col("id") % 5).alias("sold"), F.datediff("closed", "created").alias("days_to_sell"), F.lit(0.5).alias("est_roi"), ((F.col("id") % 9) / 10).alias("roi")))


def check_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(catalogue(spark, sf_dir)).withColumn("won", F.when(F.col("item").cast("long") % 5 > 0, F.col("item").cast("long") % 9 == 0))
    return O.check_stats(rows)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.proposals(check_stats(spark, sf_dir), leads(spark, sf_dir).where("price_tanked and id % 10 = 0").select("brand"))


def memory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select((F.col("id") % 3 == 0).alias("disagrees"), (F.col("id") % 2 == 0).alias("memory_used"), (F.col("id") % 7 < 3).alias("hit"))
    return O.memory_split(rows)


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.col("user_id").alias("entity"))
    return O.daily_dashboard(e, ["click", "error", "purchase", "signup", "view"])


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select(F.col("created").alias("day"), "status", (F.col("id") % 1000).alias("tokens"), (F.col("id") % 500 - 20).alias("balance"))
    return O.run_stats(rows, F.lit("2000-01-01").cast("date"))


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.open_commitments(leads(spark, sf_dir).withColumn("bought", F.when(F.col("id") % 2 == 0, F.col("id") % 4)).withColumn("suggested", F.when(F.col("id") % 5 == 0, F.lit(2))))


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).where("decision = 'buy'").select("id", F.col("created").alias("received"), (F.col("id") % 4).alias("left_units"), (F.col("id") % 7 - 3).alias("margin"))
    return O.aged_inventory(rows, F.lit("2001-09-01").cast("date")).groupBy("tier").agg(F.count("*").alias("n"), F.count_if("cut_loss").alias("cut"), F.max("days").alias("oldest"))


def proposal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ledger = e.where("event_type <> 'view'").select((F.col("user_id") % 97).alias("proposal"), F.col("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    return O.latest_status(ledger.where("proposal < 60"), e.select((F.col("user_id") % 97).alias("proposal")).distinct())


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = leads(spark, sf_dir).groupBy(F.col("created").alias("day")).agg(F.count("*").alias("n"), F.max("id").alias("k"))
    runs = days.select("day", F.when(F.col("n") > 10, "failed").otherwise("ok").alias("status"), (F.col("k") % 11 == 0).alias("drifted"), (F.col("k") % 900).alias("balance"), (F.col("k") % 13).alias("mismatches"))
    return O.health_alerts(runs).groupBy("alert").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return O.inventory_summary(p.select(F.col("p_size").cast("long").alias("owned"), (F.col("p_partkey") % 7).alias("warehouse"), (F.col("p_partkey") % 3).alias("transit"), F.col("p_name").alias("note")))


def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select("id", F.col("category").alias("signal"), F.when(F.col("id") % 3 > 0, rounded(F.col("cost") % 90, 1)).alias("discount"))
    return O.watch_summary(rows)


QUERIES = {
    "lake_kept": lake_kept, "lake_second_batch": lake_second_batch, "lake_manifest": lake_manifest, "lake_integrity": lake_integrity, "lake_digest": lake_digest,
    "lake_hashes": lake_hashes, "archived": archived, "upserts": upserts, "copies_drift": copies_drift, "sell_through": sell_through, "check_stats": check_stats,
    "proposals": proposals, "memory_split": memory_split, "dashboard": dashboard, "run_reports": run_reports, "commitments": commitments, "aged_inventory": aged,
    "proposal_status": proposal_status, "health_alerts": alerts, "inventory_summary": inventory, "watch_summary": watch,
}
_STATS = f"""{_SCORED},
won AS (SELECT *, CASE WHEN CAST(item AS BIGINT) % 5 > 0 THEN CAST(item AS BIGINT) % 9 = 0 END AS won FROM judged),
keys AS (SELECT won, unnest(list_concat(list_transform(names, lambda n: 'adjustment:' || n), [
  'check:bsr=' || CASE WHEN rank <= 200000 THEN 'pass' ELSE 'fail' END, 'check:sales=' || CASE WHEN est_sales >= 50 THEN 'pass' ELSE 'fail' END,
  'check:offers=' || CASE WHEN offers BETWEEN 3 AND 25 THEN 'pass' ELSE 'fail' END, 'check:roi=' || CASE WHEN roi >= min_roi THEN 'pass' ELSE 'fail' END,
  'check:profit=' || CASE WHEN profit >= 3 THEN 'pass' ELSE 'fail' END, 'check:buybox=' || CASE WHEN platform_has_buybox THEN 'fail' ELSE 'pass' END])) AS key FROM won WHERE won IS NOT NULL),
stats AS (SELECT key, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, count(*) >= 4 AND count(*) FILTER (WHERE NOT won) / count(*) >= 0.75 AS suggest FROM keys GROUP BY 1)"""
_TRUST = "CASE WHEN n >= 20 THEN 'high' WHEN n >= 8 THEN 'medium' ELSE 'low' END"
_KINDS = ("click", "error", "purchase", "signup", "view")
SQL = {
    "lake_kept": f"WITH {_RAW}, {_KEPT} SELECT source, entity_id, fetched_at, content_hash FROM kept",
    "lake_second_batch": f"""WITH {_RAW}, good AS (SELECT * FROM raw WHERE sha256(payload) = content_hash), m AS (SELECT source, entity_id, arg_max(content_hash, fetched_at) AS h FROM good WHERE fetched_at % 2 = 0 GROUP BY 1, 2),
      b AS (SELECT *, lag(content_hash) OVER (PARTITION BY source, entity_id ORDER BY fetched_at) AS before FROM good WHERE fetched_at % 2 = 1)
      SELECT source, entity_id, fetched_at, 'kept' AS lane FROM b LEFT JOIN m USING (source, entity_id) WHERE content_hash IS DISTINCT FROM coalesce(before, h)
      UNION ALL SELECT source, entity_id, fetched_at, 'quarantine' FROM raw WHERE fetched_at % 2 = 1 AND sha256(payload) <> content_hash""",
    "lake_manifest": f"WITH {_RAW}, {_KEPT} SELECT source, entity_id, arg_max(content_hash, fetched_at) AS content_hash, max(fetched_at) AS last_seen FROM kept GROUP BY 1, 2",
    "lake_integrity": f"WITH {_RAW} SELECT source, count(*) AS checked, count(*) FILTER (WHERE sha256(payload) <> content_hash) AS mismatches FROM raw GROUP BY 1",
    "lake_digest": f"WITH {_RAW}, {_KEPT}, s AS (SELECT count(*) AS seen FROM raw) SELECT seen, count(*) AS kept, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, {r('100 * (seen - count(*)) / seen', 1)} AS dedupe_percent FROM kept, s GROUP BY seen",
    "lake_hashes": """SELECT event_id, sha256(props) AS content, substr(sha256('{"kind": "' || event_type || '", "user": "' || user_id || '"}'), 1, 16) AS params FROM events""",
    "archived": """WITH x AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS changed, CASE WHEN event_id % 7 > 0 THEN (event_id % 10) / 10 END AS confidence FROM events)
      SELECT * FROM x WHERE NOT coalesce(NOT changed AND confidence >= 0.5, false)""",
    "upserts": f"""WITH {LEADS_SQL} SELECT 'merge' AS rule, item, category, max(id) AS first_seen, max(id) AS last_seen, arg_max(cost, id) AS cost FROM leads GROUP BY 2, 3
      UNION ALL SELECT 'freeze', item, category, coalesce(max(id) FILTER (WHERE id % 2 = 0), min(id)), coalesce(max(id) FILTER (WHERE id % 2 = 0), min(id)),
        CASE WHEN max(id) FILTER (WHERE id % 2 = 0) IS NOT NULL THEN arg_max(cost, id) FILTER (WHERE id % 2 = 0) ELSE arg_min(cost, id) END FROM leads GROUP BY 2, 3
      UNION ALL SELECT 'sightings', item, category, min(id), max(id), arg_max(cost, id) FROM leads GROUP BY 2, 3""",
    "copies_drift": f"""WITH {LEADS_SQL}, a AS (SELECT item, category, decision FROM leads), b AS (SELECT item, category, CASE WHEN id % 80 = 1 THEN 'sold' ELSE decision END AS decision FROM leads WHERE id % 50 <> 0)
      SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second""",
    "sell_through": f"""WITH {LEADS_SQL}, x AS (SELECT id % 6 AS b, id % 5 AS s, closed - created AS d, 0.5 AS e, (id % 9) / 10 AS q FROM leads WHERE closed IS NOT NULL)
      SELECT {r("avg(s / b) FILTER (WHERE b > 0)", 4)} AS sell_through, {r("365 / (avg(d) FILTER (WHERE s >= b))", 2)} AS turns, {r("avg(e - q)", 4)} AS roi_gap FROM x""",
    "check_stats": f"WITH {_STATS} SELECT * FROM stats",
    "proposals": f"""WITH {_STATS}, t AS (SELECT *, wins + losses AS n FROM stats), b AS (SELECT 'Brand#' || (o_custkey % 40) AS brand, count(*) AS n FROM orders WHERE o_orderkey % 90 = 0 GROUP BY 1)
      SELECT 'loss-rate' AS kind, key AS subject, n, {_TRUST} AS confidence FROM t WHERE suggest UNION ALL SELECT 'toothless', key, n, {_TRUST} FROM t WHERE n >= 5 AND wins = 0 AND starts_with(key, 'check:')
      UNION ALL SELECT 'brand', brand, n, {_TRUST} FROM b WHERE n >= 2""",
    "memory_split": f"WITH x AS (SELECT o_orderkey % 2 = 0 AS memory_used, CAST(o_orderkey % 7 < 3 AS INTEGER) AS hit FROM orders WHERE o_orderkey % 3 = 0) SELECT memory_used, count(*) AS n, {r('avg(hit)', 4)} AS rate, count(*) >= 15 AS enough FROM x GROUP BY 1",
    "dashboard": f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, user_id FROM events), s AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM e),
      f AS (SELECT day, count(*) AS new_entities FROM (SELECT user_id, min(day) AS day FROM e GROUP BY 1) GROUP BY 1),
      d AS (SELECT day, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS)}, count(kind) AS n FROM s LEFT JOIN e USING (day) GROUP BY 1)
      SELECT day, {", ".join(_KINDS)}, n, coalesce(new_entities, 0) AS new_entities, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cumulative, CAST(sum(n) OVER (ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS week,
        CAST(sum(n) OVER (ORDER BY day ROWS 6 PRECEDING) - coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), 0) AS BIGINT) AS trend FROM d LEFT JOIN f USING (day)""",
    "run_reports": f"SELECT o_orderstatus AS status, count(*) AS n, {r('avg(o_orderkey % 1000)', 2)} AS mean_tokens, count(*) FILTER (WHERE o_orderkey % 500 - 20 < 0) AS negative FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-01-01' GROUP BY 1",
    "commitments": f"WITH {LEADS_SQL} SELECT count(*) AS n, CAST(sum(CAST(cost * coalesce(CASE WHEN id % 2 = 0 THEN id % 4 END, CASE WHEN id % 5 = 0 THEN 2 END, 1) AS DECIMAL(18,2))) AS DOUBLE) AS committed FROM leads WHERE decision = 'buy' AND closed IS NULL",
    "aged_inventory": f"""WITH {LEADS_SQL}, x AS (SELECT id, CAST(DATE '2001-09-01' - created AS INTEGER) AS days FROM leads WHERE decision = 'buy')
      SELECT CASE WHEN days >= 181 THEN 'surcharge' WHEN days >= 150 THEN 'red' WHEN days >= 120 THEN 'amber' ELSE 'ok' END AS tier, count(*) AS n, count(*) FILTER (WHERE days >= 60 AND id % 4 > 0 AND id % 7 - 3 <= 0) AS cut, max(days) AS oldest FROM x GROUP BY 1""",
    "proposal_status": """WITH l AS (SELECT user_id % 97 AS proposal, arg_max(event_type, (ts, event_id)) AS action FROM events WHERE event_type <> 'view' AND user_id % 97 < 60 GROUP BY 1)
      SELECT proposal, coalesce(action, 'pending') AS status FROM (SELECT DISTINCT user_id % 97 AS proposal FROM events) LEFT JOIN l USING (proposal)""",
    "health_alerts": f"""WITH {LEADS_SQL}, d AS (SELECT created AS day, count(*) AS n, max(id) AS k FROM leads GROUP BY 1),
      a AS (SELECT day, unnest([CASE WHEN n > 10 THEN 'run failed' END, CASE WHEN k % 11 = 0 THEN 'snapshot drift' END, CASE WHEN k % 900 < 100 THEN 'low balance' END, CASE WHEN k % 13 > 0 THEN 'integrity mismatch' END]) AS alert FROM d)
      SELECT alert, count(*) AS n, max(day) AS last_day FROM a WHERE alert IS NOT NULL GROUP BY 1""",
    "inventory_summary": "SELECT CAST(sum(p_size) AS BIGINT) AS owned, CAST(sum(p_partkey % 7) AS BIGINT) AS warehouse, CAST(sum(p_partkey % 3) AS BIGINT) AS transit, count(*) FILTER (WHERE contains(lower(p_name), 'low')) AS low_stock FROM part",
    "watch_summary": f"""WITH {LEADS_SQL}, d AS (SELECT id, category AS signal, CASE WHEN id % 3 > 0 THEN {r("cost % 90", 1)} END AS discount FROM leads)
      SELECT 'signal' AS kind, signal AS ref, count(*) AS n, max(discount) AS best FROM d GROUP BY 2 UNION ALL (SELECT 'find', CAST(id AS VARCHAR), 1, discount FROM d ORDER BY discount DESC NULLS LAST, id LIMIT 8)""",
}
