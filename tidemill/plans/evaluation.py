"""Queries that measure scores, predictions and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scoring as S
from tidemill.functions.rounding import rounded
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import corpus as B
from tidemill.operators import evaluate as E
from tidemill.operators import train as R
from tidemill.plans.points_in_time import backtest_rows
from tidemill.plans.tables import CATALOGUE_SQL, catalogue, read
from tidemill.sources.folders import saved


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two scores that tie often."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    toxic = F.col("toxic") == 1
    return rows.select(
        "doc_id", "lang", "source", toxic.alias("toxic"),
        F.when(F.col("doc_id") % 37 != 0, (F.col("n_chars") % 200 + F.when(toxic, 40).otherwise(0)) / 300).alias("score"),
        ((F.col("doc_id") * 31 % 100 + F.when(toxic, 20).otherwise(0)) / 200).alias("other"),
        F.col("n_chars"),
    )


_S = """sc AS (SELECT doc_id, lang, source, toxic = 1 AS toxic, CASE WHEN doc_id % 37 <> 0 THEN (n_chars % 200 + CASE WHEN toxic = 1 THEN 40 ELSE 0 END) / 300 END AS score,
  (doc_id * 31 % 100 + CASE WHEN toxic = 1 THEN 20 ELSE 0 END) / 200 AS other, n_chars FROM documents JOIN labels USING (doc_id))"""


def auc_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("toxic", "score", F.explode(F.array(F.lit("all"), F.col("lang"))).alias("slice"))
    return E.auc(rows, "score", "toxic", ["slice"])


def pr_auc_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pr_auc(scores(spark, sf_dir), "score", "toxic", ["lang"])


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_k(scores(spark, sf_dir), "score", "toxic", "doc_id", 50)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_bins(scores(spark, sf_dir).where("score is not null"), "score", "toxic")


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(calibration(spark, sf_dir))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    return E.psi(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1").withColumn("l_quantity", F.col("l_quantity") * 0.8 + 5), cols)


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.null_profile(catalogue(spark, sf_dir), ["price", "weight_lb", "offers", "avg_sales_rank_90", "platform_share", "oos_90"])


def quantile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regression_quality(scores(spark, sf_dir).where("score is not null"), "score", "other", 0.2)


def auc_gap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap_gap(scores(spark, sf_dir).where("score is not null"), "other", "score", "toxic", "source")


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC over nested samples of sources by hash, each larger one holding the smaller."""
    rows = scores(spark, sf_dir).withColumn("h", B.hash_share(F.col("doc_id")))
    sizes = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 1.0)])).alias("share")
    return E.auc(rows.select("*", sizes).where("h < share"), "score", "toxic", ["share"])


def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month of orders as a training run."""
    runs = read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("date")).cast("date").alias("trained_at")).agg(F.count("*").alias("n"))
    k = F.year("trained_at") * 12 + F.month("trained_at")
    runs = runs.select(
        "trained_at", "n", F.lit(0.70).alias("champion"), F.when(k % 7 == 0, 0.71).otherwise(0.74).alias("challenger"),
        F.lit(0.60).alias("time_champion"), F.lit(0.65).alias("time_challenger"), F.sha2((k / 2).cast("int").cast("string"), 256).alias("content"),
    )
    return E.promotion(runs, 0.02, 3, 50)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.coalesce("score", F.lit(0.0)) >= 0.5) == F.col("toxic")).alias("hits"))
    low, high = E.wilson(F.col("hits"), F.col("n"))
    return rows.select("source", "n", "hits", rounded(F.col("hits") / F.col("n"), 4).alias("accuracy"), low.alias("low"), high.alias("high"))


def claim_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir).withColumn("made_at", F.col("first_day"))
    stats = c.select("item", (F.col("price") * 0.9).alias("price_now"), (F.col("offers") + F.col("item").cast("long") % 3 - 1).alias("offers_now"), (F.col("est_sales") * (F.col("item").cast("long") % 4) / 3).alias("sales_now"))
    found = E.resolve_claims(E.claims(c), stats, F.lit("1996-01-01").cast("date"))
    return found.groupBy("claim").agg(F.count("*").alias("scored"), F.count_if("hit").alias("hits"), F.min("horizon").alias("horizon"), rounded(F.sum(F.col("threshold").cast("decimal(18,2)")).cast("double"), 2).alias("thresholds"))


def clear_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).where("score > 0.6 or score < 0.1").withColumn("good", F.col("score") > 0.6)
    return E.alternate(rows, "good", ["doc_id"], 10).select("doc_id", "good", "turn")


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation and extremes of a measure by configuration."""
    rows = scores(spark, sf_dir)
    v = F.col("n_chars").cast("decimal(18,0)")
    n, s, ss = F.count("*"), F.sum(v), F.sum((v * v).cast("decimal(38,0)"))
    var = (ss.cast("double") - s.cast("double") * s.cast("double") / n) / (n - 1)
    return rows.groupBy("lang").agg(n.alias("n"), rounded(s.cast("double") / n, 3).alias("mean"), rounded(F.sqrt(var), 2).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


FEATURES = ["price_as_of", "offers_as_of", "landed_cost"]


def trained_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of a trained classifier on items it hasn't seen."""
    rows = saved(B.split_by_item(backtest_rows(spark, sf_dir)).select("item", "fold", "success", *FEATURES))
    model = R.fit_classifier(rows.where("fold = 'train'"), FEATURES, "success")
    held = R.probabilities(model, rows.where("fold = 'validation'"), FEATURES)
    return E.auc(held, "probability", "success", ["fold"])


def refit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC on held-out items of classifiers that are fitted anew on growing, nested samples of the other items."""
    rows = B.split_by_item(backtest_rows(spark, sf_dir)).select("item", "fold", "success", *FEATURES)
    rows = rows.withColumn("h", B.hash_share(F.concat(F.lit("curve"), F.col("item").cast("string")))).persist()
    held, found = rows.where("fold = 'validation'"), None
    for share in (0.25, 0.5, 1.0):
        some = rows.where((F.col("fold") == "train") & (F.col("h") < share))
        if R.refusal(some, "success"):  # a sample of too few rows, or of one class, gives no point
            continue
        scored = R.probabilities(R.fit_classifier(some, FEATURES, "success"), held, FEATURES).withColumn("share", F.lit(share))
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return spark.createDataFrame([], "share double, positives long, negatives long, auc double")
    return E.auc(found, "probability", "success", ["share"])


def trained_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of boosted trees on items they haven't seen."""
    rows = saved(B.split_by_item(backtest_rows(spark, sf_dir)).select("item", "fold", "success", *FEATURES))
    model = R.fit_classifier(rows.where("fold = 'train'"), FEATURES, "success", trees=True)
    return E.auc(R.probabilities(model, rows.where("fold = 'validation'"), FEATURES), "probability", "success", ["fold"])


def quantile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a linear model of the low quantile of the price does on items it hasn't seen."""
    rows = B.split_by_item(backtest_rows(spark, sf_dir)).where("price_as_of is not null and offers_as_of is not null and landed_cost is not null")
    rows = saved(rows.select("fold", *FEATURES))
    *slopes, constant = R.quantile_line(rows.where("fold = 'train'"), ["offers_as_of", "landed_cost"], "price_as_of", 0.2)
    line = F.lit(constant) + slopes[0] * F.col("offers_as_of") + slopes[1] * F.col("landed_cost")
    return E.regression_quality(rows.where("fold = 'validation'").withColumn("q", line), "price_as_of", "q", 0.2)


def trained_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(backtest_rows(spark, sf_dir).select("item", "success", *FEATURES))
    return R.calibration_summary(rows, FEATURES, "success", F.when(B.hash_share(F.col("item")) < 0.3, "validation").otherwise("train"))


def newest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("created"), F.when(F.col("o_orderkey") % 9 > 0, (F.col("o_orderkey") % 50) / 50).alias("pr_auc"))
    return E.promote_newest(rows)


def fallen_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("run")).agg(F.count("*").alias("value"))
    return E.regressions(rows)


def deal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = {"platform": ~F.col("platform_has_buybox")}
    core = {"price": F.col("price") > 10, "rank": F.col("sales_rank") <= 200000}
    soft = {"offers": F.col("offers").between(3, 25), "weight": F.col("weight_lb") <= 3}
    verdict, checks = S.deal_verdict(hard, core, soft)
    failed = F.size(F.filter(checks, lambda c: ~F.coalesce(c["passed"], F.lit(True))))
    return catalogue(spark, sf_dir).select("item", verdict.alias("verdict"), failed.alias("failed"))


QUERIES = {
    "trained_ranker": trained_ranker, "trained_calibration": trained_calibration, "newest_models": newest_models, "fallen_metrics": fallen_metrics, "deal_verdicts": deal_verdicts,
    "auc_by_slice": auc_by_slice, "pr_auc_by_slice": pr_auc_by_slice, "top_k_quality": top_k, "calibration": calibration, "calibration_error": calibration_error,
    "drift": drift, "data_quality": data_quality, "quantile_quality": quantile_quality, "auc_gap_interval": auc_gap_interval, "learning_curve": learning_curve, "refit_curve": refit_curve, "trained_trees": trained_trees, "quantile_fit": quantile_fit,
    "promotion": promotion, "agreement": agreement, "claim_hits": claim_hits, "clear_cases": clear_cases, "benchmark_summary": benchmark_summary,
}


def _auc(rows: str, by: str) -> str:
    return f"""x AS ({rows}), g AS (SELECT {by}, coalesce(score, -1e308) AS s, count(*) FILTER (WHERE toxic) AS p, count(*) FILTER (WHERE NOT toxic) AS n FROM x GROUP BY 1, 2),
  c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
  SELECT {by}, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN {r("sum(p * (2 * nb + n)) / (2 * sum(p) * sum(n))", 6)} END AS auc FROM c GROUP BY 1"""


_BINS = f"""b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r("CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*)", 6)} AS predicted,
  {r("count(*) FILTER (WHERE toxic) / count(*)", 6)} AS rate FROM sc WHERE score IS NOT NULL GROUP BY 1)"""
_PSI = lambda c: f"""SELECT '{c}' AS name, {r("sum((o - e) * ln(o / e))", 4)} AS psi FROM (
  SELECT bin, greatest(coalesce(b, 0) / sum(coalesce(b, 0)) OVER (), 1e-6) AS e, greatest(coalesce(a, 0) / sum(coalesce(a, 0)) OVER (), 1e-6) AS o
  FROM (SELECT unnest(range(1, len(edges))) AS bin FROM e_{c}) cells
  LEFT JOIN (SELECT least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS bin, count(*) AS b FROM (SELECT {c} AS v FROM lineitem WHERE l_orderkey % 2 = 0), e_{c} GROUP BY 1) USING (bin)
  LEFT JOIN (SELECT least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1) AS bin, count(*) AS a FROM (SELECT {c + ' * 0.8::DOUBLE + 5' if c == 'l_quantity' else c} AS v FROM lineitem WHERE l_orderkey % 2 = 1), e_{c} WHERE v BETWEEN edges[1] AND edges[-1] GROUP BY 1) USING (bin))"""  # noqa: E731
_EDGES = lambda c: f"e_{c} AS (SELECT list_sort(list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM lineitem WHERE l_orderkey % 2 = 0)"
_COLS = ("l_quantity", "l_discount", "l_extendedprice")
SQL = {
    "newest_models": """WITH m AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderkey AS c, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 50) / 50 END AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders),
      g AS (SELECT name, count(*) AS models, max(v) FILTER (WHERE k = 1) AS challenger, max(v) FILTER (WHERE k = 2) AS champion FROM m WHERE k <= 2 GROUP BY 1)
      SELECT *, models = 1 OR coalesce(CAST(challenger - champion AS DECIMAL(18,6)) >= 0.02, false) AS promoted FROM g""",
    "fallen_metrics": """WITH c AS (SELECT o_orderpriority AS metric, CAST(year(o_orderdate) AS INTEGER) AS run, count(*) AS value FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run) AS before FROM c)
      SELECT * FROM l WHERE value < before""",
    "deal_verdicts": f"""WITH {CATALOGUE_SQL}, f AS (SELECT item, CAST(platform_has_buybox AS INTEGER) AS h, coalesce(CAST(price <= 10 AS INTEGER), 0) + CAST(sales_rank > 200000 AS INTEGER) AS c,
        coalesce(CAST(offers NOT BETWEEN 3 AND 25 AS INTEGER), 0) + coalesce(CAST(weight_lb > 3 AS INTEGER), 0) AS s FROM catalogue)
      SELECT item, CASE WHEN h + c > 0 THEN 'PASS' WHEN s > 0 THEN 'REVIEW' ELSE 'BUY' END AS verdict, CAST(h + c + s AS INTEGER) AS failed FROM f""",
    "auc_by_slice": f"WITH {_S}, {_auc('''SELECT toxic, score, unnest(['all', lang]) AS slice FROM sc''', 'slice')}",
    "pr_auc_by_slice": f"""WITH {_S}, g AS (SELECT lang, coalesce(score, -1e308) AS s, count(*) FILTER (WHERE toxic) AS p, count(*) FILTER (WHERE NOT toxic) AS n FROM sc GROUP BY 1, 2),
      c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC)) SELECT lang, CASE WHEN sum(p) > 0 THEN {r("sum(p * cp / (cp + cn)) / nullif(sum(p), 0)", 6)} END AS pr_auc FROM c GROUP BY 1""",
    "top_k_quality": f"""WITH {_S}, k AS (SELECT toxic, row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id) AS rn FROM sc), t AS (SELECT count(*) AS a, count(*) FILTER (WHERE toxic) AS p FROM sc),
      m AS (SELECT count(*) FILTER (WHERE toxic) AS w, count(*) AS n, coalesce(sum(CAST(toxic AS INTEGER) / log2(rn + 1)), 0) AS dcg FROM k WHERE rn <= 50),
      i AS (SELECT sum(1 / log2(x + 1)) AS ideal FROM t, (SELECT unnest(range(1, 51)) AS x) WHERE x <= p)
      SELECT w AS winners, {r("w / n", 6)} AS precision, {r("w / p", 6)} AS recall, {r("p / a", 6)} AS base_rate, {r("w / n / (p / a)", 4)} AS lift, {r("dcg / ideal", 6)} AS ndcg FROM m, t, i""",
    "calibration": f"WITH {_S}, {_BINS} SELECT * FROM b",
    "calibration_error": f"WITH {_S}, {_BINS} SELECT {r('sum(abs(predicted - rate) * n) / sum(n)', 6)} AS ece FROM b",
    "drift": f"WITH {', '.join(map(_EDGES, _COLS))} {' UNION ALL '.join(map(_PSI, _COLS))}",
    "data_quality": f"WITH {CATALOGUE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS name, {r(f'count(*) FILTER (WHERE {c} IS NULL OR {c} = 0) / count(*)', 4)} AS share FROM catalogue" for c in ("price", "weight_lb", "offers", "avg_sales_rank_90", "platform_share", "oos_90")),
    "quantile_quality": f"""WITH {_S}, d AS (SELECT score - other AS d FROM sc WHERE score IS NOT NULL)
      SELECT {r("CAST(sum(CAST(CASE WHEN d >= 0 THEN 0.2 * d ELSE (0.2 - 1) * d END AS DECIMAL(18,6))) AS DOUBLE) / count(*)", 5)} AS pinball, {r("count(*) FILTER (WHERE d < 0) / count(*)", 5)} AS over,
        {r("count(*) FILTER (WHERE d >= 0) / count(*)", 5)} AS coverage, {r("CAST(sum(CAST(abs(d) AS DECIMAL(18,6))) AS DOUBLE) / count(*)", 5)} AS mae FROM d""",
    "learning_curve": f"""WITH {_S}, {_auc("SELECT toxic, score, share FROM (SELECT *, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000 / 1000 AS h FROM sc), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) t(share) WHERE h < share", "share")}""",
    "promotion": """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, year(t) * 12 + month(t) AS k FROM m),
      d AS (SELECT k // 2 AS c, max(t) AS t, arg_max(n, t) AS n, arg_max(CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END, t) AS won FROM k GROUP BY 1),
      s AS (SELECT *, min(won) OVER (ORDER BY t DESC) AS streak FROM d), a AS (SELECT CAST(sum(streak) AS BIGINT) AS streak, arg_max(n, t) AS n, count(*) AS distinct_runs FROM s)
      SELECT streak, n, distinct_runs, CASE WHEN n < 50 THEN 'small sample' WHEN streak >= 3 THEN 'promote' ELSE 'keep' END AS verdict FROM a""",
    "agreement": f"""WITH {_S}, g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE (coalesce(score, 0) >= 0.5) = toxic) AS hits FROM sc GROUP BY 1),
      w AS (SELECT *, hits / n AS p, 1.96 AS z FROM g)
      SELECT source, n, hits, {r("p", 4)} AS accuracy, {r("greatest((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 0)", 4)} AS low, {r("least((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 1)", 4)} AS high FROM w""",
    "claim_hits": f"""WITH {CATALOGUE_SQL}, c AS (
        SELECT item, first_day, 'price_reversion' AS claim, avg_price_90 AS threshold, 14 AS horizon, price * 0.9 <= avg_price_90 AS hit FROM catalogue WHERE price > 1.15 * avg_price_90
        UNION ALL SELECT item, first_day, 'offer_trend', offers, 14, offers + CAST(item AS BIGINT) % 3 - 1 >= offers FROM catalogue WHERE offers > 1.4 * avg_offers_90
        UNION ALL SELECT item, first_day, 'velocity', {r("est_sales * 0.7", 2)}, 30, est_sales * (CAST(item AS BIGINT) % 4) / 3 >= {r("est_sales * 0.7", 2)} FROM catalogue WHERE est_sales > 0)
      SELECT claim, count(*) AS scored, count(*) FILTER (WHERE hit) AS hits, CAST(min(horizon) AS INTEGER) AS horizon, CAST(sum(CAST(threshold AS DECIMAL(18,2))) AS DOUBLE) AS thresholds
      FROM c WHERE DATE '1996-01-01' - first_day >= horizon GROUP BY 1""",
    "clear_cases": f"""WITH {_S}, k AS (SELECT doc_id, score > 0.6 AS good, row_number() OVER (PARTITION BY score > 0.6 ORDER BY doc_id) AS turn FROM sc WHERE score > 0.6 OR score < 0.1)
      SELECT doc_id, good, CAST(turn AS INTEGER) AS turn FROM k ORDER BY turn, good DESC LIMIT 10""",
    "benchmark_summary": f"""WITH {_S} SELECT lang, count(*) AS n, {r("CAST(sum(n_chars) AS DOUBLE) / count(*)", 3)} AS mean, {r("stddev_samp(n_chars)", 2)} AS std, min(n_chars) AS least, max(n_chars) AS most FROM sc GROUP BY 1""",
}
