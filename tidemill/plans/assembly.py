"""Queries that assemble, cap, split and describe training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import corpus as B
from tidemill.plans.tables import LEADS_SQL, leads, read

NOW = "2001-07-01"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of three tiers."""
    rows = leads(spark, sf_dir)
    label = B.outcome_label(F.col("would_rebuy"), F.col("profit"), F.col("price_tanked"))
    tier = F.when(F.col("id") % 10 < 6, "backtest").when(F.col("id") % 10 < 9, "silver").otherwise("gold")
    source = F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 4))
    return rows.where("closed is not null").select("id", "item", "brand", "category", "created", tier.alias("tier"), label.alias("label"), source.alias("source"), "cost", "profit")


_ROWS = f"""{LEADS_SQL}, rws AS (
  SELECT id, item, brand, category, created, CASE WHEN id % 10 < 6 THEN 'backtest' WHEN id % 10 < 9 THEN 'silver' ELSE 'gold' END AS tier,
    coalesce(would_rebuy, profit > 0 AND NOT price_tanked) AS label, CASE WHEN id % 4 > 0 THEN 's' || (id % 4) END AS source, cost, profit FROM leads WHERE closed IS NOT NULL)"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    pending = B.enqueue_checkpoints(rows.where("decision = 'buy'").select("id", "item", F.col("created").alias("enqueued_at"), F.col("cost").alias("landed_cost")))
    shots = rows.select("item", F.col("created").alias("snapshot_day"), F.col("cost").alias("price")).groupBy("item", "snapshot_day").agg(F.max("price").alias("price"))
    out = B.recheck(pending, shots, F.lit(NOW).cast("date"))
    return out.select("id", "checkpoint_day", "due_at", "status", "profit_now")


def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome labels where there is an outcome, decisions where there is none, by item key."""
    rows = leads(spark, sf_dir)
    keyed = rows.withColumn("key", B.match_key(F.when(F.col("id") % 3 > 0, F.col("item")), F.col("brand")))
    outcome = B.outcome_label(F.col("would_rebuy"), F.col("profit"), F.col("price_tanked"))
    outcomes = keyed.where("closed is not null").select("key", F.struct("closed", "id").alias("at"), outcome.alias("label"))
    decisions = keyed.where("closed is null").select("key", F.struct("created", "id").alias("at"), B.decision_label(F.col("decision")).alias("label"))
    return B.assemble_tiers(outcomes, decisions)


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).groupBy("tier")
    return rows.agg(F.count("*").alias("n"), F.count_if("label").alias("positive"), F.count_if(~F.col("label")).alias("negative"), F.sum(B.tier_weight(F.col("tier"))).alias("weight"))


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak and strong labels of items, the better one kept."""
    rows = leads(spark, sf_dir)
    weak = B.weak_score({"a": ((F.col("id") % 11) / 10, 0.30), "b": ((F.col("id") % 7) / 6, 0.20), "c": ((F.col("id") % 5) / 4, 0.20), "d": ((F.col("id") % 3) / 2, 0.15), "e": (F.col("profit"), -0.10), "f": (F.col("cost") / 500, -0.05)})
    strong = F.col("closed").isNotNull() & (F.col("id") % 4 == 0)
    out = rows.select("item", weak.alias("score"), strong.alias("strong"), F.coalesce("closed", "created").alias("end_date"), F.col("id").alias("seq"), (F.col("id") % 13 == 0).alias("censored"))
    kept = B.prefer_strong(out)
    return kept.select("item", "score", (F.col("score") >= 0.60).alias("label"), "strong", "end_date", "weight")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("id", "item", "created")
    by_item = B.split_by_item(rows).withColumnRenamed("fold", "item_fold")
    return B.split_by_time(by_item, "created", "id").select("id", "item_fold", F.col("fold").alias("time_fold"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.createDataFrame([(1, "1998-01-01", "1999-01-01"), (2, "1999-01-01", "2000-01-01"), (3, "2000-01-01", "2001-01-01")], "fold int, start string, stop string")
    bounds = bounds.select("fold", F.to_date("start").alias("start"), F.to_date("stop").alias("stop"))
    out = B.purged_folds(_rows(spark, sf_dir), "created", bounds)
    return out.groupBy("fold", "role").agg(F.count("*").alias("n"), F.count_if("label").alias("wins"), F.min("created").alias("first_day"), F.max("created").alias("last_day"))


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.corpus_caps(_rows(spark, sf_dir).withColumn("brand", F.when(F.col("id") % 5 == 0, "hot").otherwise(F.col("brand"))), ["item", "id"]).select("id", "category", "brand")


_H = "CAST('0x' || substr(sha256(item || '|' || id), 1, 8) AS BIGINT)"


def concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return B.concentration(rows, "category", 0.30).unionByName(B.concentration(rows, "brand", 0.25))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fingerprint(_rows(spark, sf_dir), ["id", "item", "tier", "label"]).select("n_rows", "content")


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.interleave(leads(spark, sf_dir).where("decision = 'defer'"), "category", "id").select("id", "category", "turn")


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    parts = [rows.where(F.col("decision") == d).groupBy("item").agg(F.min("id").alias("pos")) for d in ("buy", "defer", "pass")]
    return B.waterfall(parts, 200)


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.composition(_rows(spark, sf_dir), "source")


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that nobody decided on, by the first category that is known."""
    rows = leads(spark, sf_dir)
    first = B.undecided(rows.where("decision = 'defer'"), rows.where("decision <> 'defer'"))
    return first.groupBy("category").agg(F.count("*").alias("n"))


def resolved_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    queue = rows.select("item", "id", "created", F.when(F.col("id") % 2 == 0, "pending").otherwise("done").alias("status"))
    decisions = rows.groupBy("item").agg(F.max(F.struct("created", "id", "decision")).alias("x")).select("item", F.col("x.created").alias("decided"), "x.decision")
    return B.resolve_queue(queue, decisions).select("item", "id", "decision", "label", "status")


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    survivors = rows.select("item").distinct()
    answer = F.when(F.col("id") % 3 == 0, "ALLOWED").when(F.col("id") % 3 == 1, "APPROVAL_REQUIRED").otherwise("NOT_ELIGIBLE")
    cached = rows.groupBy("item", F.col("created").alias("fetched")).agg(F.max("id").alias("id")).withColumn("eligibility", answer).drop("id")
    return B.attach_eligibility(survivors, cached, F.lit("2001-07-20").cast("date"), 60).select("item", "eligibility", "rejected", "needs_approval")


QUERIES = {
    "checkpoints": checkpoints, "outcome_labels": outcome_labels, "tier_counts": tier_counts, "weak_labels": weak_labels, "splits": splits,
    "purged_folds": folds, "corpus_caps": capped, "concentration": concentrations, "fingerprint": fingerprint, "interleaved": interleaved,
    "waterfall": waterfall, "composition": composition, "backlog": backlog, "resolved_queue": resolved_queue, "eligibility": eligibility,
}
_CONC = lambda by, alarm: f"""SELECT '{by}' AS dimension, count(*) AS distinct_values, {r("max(n / t)", 4)} AS top_share,
  {r("sum(n) FILTER (WHERE k <= 5) / max(t)", 4)} AS top5_share, {r("sum((n / t) * (n / t))", 6)} AS hhi, {r("max(n / t)", 4)} > {alarm} AS alarm
  FROM (SELECT {by}, count(*) AS n, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY count(*) DESC, {by}) AS k FROM rws GROUP BY 1)"""  # noqa: E731
SQL = {
    "checkpoints": f"""WITH {LEADS_SQL}, shots AS (SELECT item, created AS d, max(cost) AS p FROM leads GROUP BY 1, 2), last AS (SELECT item, max(d) AS d, arg_max(p, d) AS p FROM shots GROUP BY 1),
      q AS (SELECT id, item, cost, k AS checkpoint_day, created + k AS due_at FROM leads, (VALUES (30), (60)) t(k) WHERE decision = 'buy')
      SELECT id, checkpoint_day, due_at, CASE WHEN due_at <= DATE '{NOW}' AND d >= due_at THEN 'done' ELSE 'pending' END AS status,
        CASE WHEN due_at <= DATE '{NOW}' AND d >= due_at THEN {r("p * 0.6 - cost", 2)} END AS profit_now FROM q LEFT JOIN last USING (item)""",
    "outcome_labels": f"""WITH {LEADS_SQL}, k AS (SELECT *, CASE WHEN id % 3 > 0 THEN upper(item) ELSE lower(brand) END AS key FROM leads),
      s AS (SELECT key, arg_max(coalesce(would_rebuy, profit > 0 AND NOT price_tanked), (closed, id)) AS label FROM k WHERE closed IS NOT NULL GROUP BY 1),
      b AS (SELECT key, arg_max(decision = 'buy', (created, id)) AS label FROM k WHERE closed IS NULL AND decision <> 'defer' AND key NOT IN (SELECT key FROM s) GROUP BY 1)
      SELECT key, label, 'silver' AS tier FROM s UNION ALL SELECT key, label, 'bronze' FROM b""",
    "tier_counts": f"WITH {_ROWS} SELECT tier, count(*) AS n, count(*) FILTER (WHERE label) AS positive, count(*) FILTER (WHERE NOT label) AS negative, CAST(sum(CASE tier WHEN 'gold' THEN 4 WHEN 'silver' THEN 2 ELSE 1 END) AS DOUBLE) AS weight FROM rws GROUP BY 1",
    "weak_labels": f"""WITH {LEADS_SQL}, s AS (SELECT item, id, {r("0.30 * ((id % 11) / 10) + 0.20 * ((id % 7) / 6) + 0.20 * ((id % 5) / 4) + 0.15 * ((id % 3) / 2) - 0.10 * coalesce(profit, 0) - 0.05 * (cost / 500)", 4)} AS score,
        closed IS NOT NULL AND id % 4 = 0 AS strong, coalesce(closed, created) AS end_date FROM leads WHERE id % 13 <> 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY strong DESC, end_date DESC, id DESC) AS rn FROM s)
      SELECT item, score, score >= 0.60 AS label, strong, end_date, CASE WHEN strong THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM k WHERE rn = 1""",
    "splits": f"""WITH {_ROWS}, n AS (SELECT greatest(1, round_even(count(*) * 0.3, 0)) AS want FROM rws), k AS (SELECT *, row_number() OVER (ORDER BY created DESC, id DESC) AS rn FROM rws)
      SELECT id, CASE WHEN CAST('0x' || substr(sha256(item), 1, 8) AS BIGINT) % 1000 / 1000 < 0.3 THEN 'validation' ELSE 'train' END AS item_fold, CASE WHEN rn <= want THEN 'validation' ELSE 'train' END AS time_fold FROM k, n""",
    "purged_folds": f"""WITH {_ROWS}, b(fold, start, stop) AS (VALUES (1, DATE '1998-01-01', DATE '1999-01-01'), (2, DATE '1999-01-01', DATE '2000-01-01'), (3, DATE '2000-01-01', DATE '2001-01-01')),
      j AS (SELECT *, CASE WHEN created >= start THEN 'test' WHEN created < start - 60 THEN 'train' END AS role FROM rws JOIN b ON created < stop)
      SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, count(*) FILTER (WHERE label) AS wins, min(created) AS first_day, max(created) AS last_day FROM j WHERE role IS NOT NULL GROUP BY 1, 2""",
    "corpus_caps": f"""WITH {_ROWS}, h AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'hot' ELSE brand END AS brand), {_H} AS h, count(*) OVER () AS n FROM rws),
      c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, item, id) AS rc FROM h),
      d AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY h, item, id) AS rb FROM c WHERE rc <= greatest(1, floor(n * 0.30)))
      SELECT id, category, brand FROM d WHERE rb <= greatest(1, floor(n * 0.06))""",
    "concentration": f"WITH {_ROWS} {_CONC('category', 0.30)} UNION ALL {_CONC('brand', 0.25)}",
    "fingerprint": f"""WITH {_ROWS}, x AS (SELECT sha256(concat_ws(chr(31), id, item, tier, CAST(label AS VARCHAR))) AS h FROM rws),
      p AS (SELECT substr(h, 1, 2) AS b, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 3, 8) AS BIGINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || substr(h, 11, 8) AS BIGINT)) AS VARCHAR) AS c FROM x GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(concat_ws(':', b, n, a, c), '|' ORDER BY concat_ws(':', b, n, a, c))) AS content FROM p""",
    "interleaved": f"WITH {LEADS_SQL} SELECT id, category, CAST(row_number() OVER (PARTITION BY category ORDER BY id) AS INTEGER) AS turn FROM leads WHERE decision = 'defer'",
    "waterfall": f"""WITH {LEADS_SQL}, s AS (SELECT item, CASE decision WHEN 'buy' THEN 0 WHEN 'defer' THEN 1 ELSE 2 END AS source, min(id) AS pos FROM leads GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY source, pos) AS rn FROM s) SELECT item, CAST(source AS INTEGER) AS source, pos FROM k WHERE rn = 1 ORDER BY source, pos, item LIMIT 200""",
    "composition": f"WITH {_ROWS}, c AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM rws GROUP BY 1) SELECT source, n, {r('100 * n / (SELECT sum(n) FROM c)', 1)} AS percent FROM c",
    "backlog": f"""WITH {LEADS_SQL}, o AS (SELECT item, arg_min(category, id) AS category FROM leads WHERE decision = 'defer' AND item NOT IN (SELECT item FROM leads WHERE decision <> 'defer') GROUP BY 1)
      SELECT category, count(*) AS n FROM o GROUP BY 1""",
    "resolved_queue": f"""WITH {LEADS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY created DESC, id DESC) AS rn FROM leads WHERE id % 2 = 0),
      d AS (SELECT item, arg_max(decision, (created, id)) AS decision FROM leads GROUP BY 1)
      SELECT item, id, d.decision, CASE d.decision WHEN 'buy' THEN true WHEN 'pass' THEN false END AS label, 'resolved' AS status FROM p JOIN d USING (item) WHERE rn = 1""",
    "eligibility": f"""WITH {LEADS_SQL}, c AS (SELECT item, arg_max(id, (created, id)) AS id FROM leads WHERE DATE '2001-07-20' - created <= 60 GROUP BY 1),
      e AS (SELECT item, CASE id % 3 WHEN 0 THEN 'ALLOWED' WHEN 1 THEN 'APPROVAL_REQUIRED' ELSE 'NOT_ELIGIBLE' END AS eligibility FROM c)
      SELECT item, eligibility, coalesce(eligibility = 'NOT_ELIGIBLE', false) AS rejected, coalesce(eligibility = 'APPROVAL_REQUIRED', false) AS needs_approval FROM (SELECT DISTINCT item FROM leads) LEFT JOIN e USING (item)""",
}
