"""Queries that fit models: calibrated probabilities, boosted quantiles, a listwise ranker, walk-forward refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.rounding import rounded
from tidemill.functions.rounding import sql_rounded as r
from tidemill.operators import boosting, calibrate, walkforward
from tidemill.operators import corpus as B
from tidemill.operators import evaluate as E
from tidemill.operators import train as R
from tidemill.plans.evaluation import _S, FEATURES, scores
from tidemill.plans.points_in_time import backtest_rows
from tidemill.sources.folders import saved


def isotonic_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of scores with one rate each, the rates rising."""
    blocks = calibrate.isotonic_blocks(scores(spark, sf_dir), "score", "toxic")
    return blocks.select(rounded(F.col("lo"), 6).alias("lo"), rounded(F.col("hi"), 6).alias("hi"), "n", "pos", rounded(F.col("pos") / F.col("n"), 6).alias("rate"))


def lift_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lift_at(scores(spark, sf_dir).where("score is not null"), "score", "toxic", ["lang"])


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest rows, of items that train, calibrate or are held out."""
    rows = B.split_by_item(backtest_rows(spark, sf_dir)).select("item", "as_of", "fold", "success", *FEATURES)
    spare = B.hash_share(F.concat(F.lit("spare"), F.col("item").cast("string"))) < 0.35
    return saved(rows.withColumn("fold", F.when((F.col("fold") == "train") & spare, "calibration").otherwise(F.col("fold"))))


def calibrated_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error of boosted trees on held-out items, before and after an isotonic fit on items of their own."""
    rows = _split(spark, sf_dir)
    model = R.fit_classifier(rows.where("fold = 'train'"), FEATURES, "success", trees=True)
    scored = saved(R.probabilities(model, rows.where("fold <> 'train'"), FEATURES))
    fit = calibrate.fit_calibration(scored.where("fold = 'calibration'"), "probability", "success")
    held = saved(fit.apply(scored.where("fold = 'validation'"), "probability", "calibrated"))
    falls = held.groupBy("probability").agg(F.min("calibrated").alias("c")).orderBy("probability")
    # probabilities have six digits, so there are a million different ones at most
    falls = falls.select(F.when(F.col("c") < F.max("c").over(W.orderBy("probability").rowsBetween(W.unboundedPreceding, -1)), 1).alias("f"))
    errors = [E.calibration_error(E.calibration_bins(held, c, "success")).withColumnRenamed("ece", c) for c in ("probability", "calibrated")]
    out = errors[0].crossJoin(errors[1]).crossJoin(falls.agg(F.count("f").alias("falls"))).crossJoin(held.agg(F.count("*").alias("n")))  # a row each
    return out.select("n", F.col("probability").alias("raw_error"), F.col("calibrated").alias("calibrated_error"), "falls")


def boosted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A low quantile of the price at the horizon on items that weren't seen: a constant, a line, and boosted trees."""
    features = ["price_as_of", "offers_as_of", "landed_cost"]
    rows = B.split_by_item(backtest_rows(spark, sf_dir)).where("price_as_of is not null and offers_as_of is not null and price_at_horizon is not null")
    rows = saved(rows.select("item", "fold", "price_at_horizon", *features))
    train, held = rows.where("fold = 'train'"), rows.where("fold = 'validation'")
    if train.isEmpty():
        return spark.createDataFrame([], "model string, pinball double, over double, coverage double, mae double")
    constant = train.agg(F.percentile_approx("price_at_horizon", F.lit(0.2))).first()[0]
    *slopes, rest = R.quantile_line(train, features, "price_at_horizon", 0.2)
    trees = boosting.quantile_trees(train, features, "price_at_horizon", 0.2)
    line = sum((F.lit(a) * F.col(f) for a, f in zip(slopes, features, strict=True)), F.lit(rest))
    held = trees.score(held.withColumn("constant", F.lit(constant)).withColumn("line", line), "trees")
    found = [E.regression_quality(held, "price_at_horizon", c, 0.2).select(F.lit(c).alias("model"), "*") for c in ("constant", "line", "trees")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def group_ndcg(rows: DataFrame, score: str, label: str, group: str, k: int) -> DataFrame:
    """Mean NDCG of the best ``k`` rows of each group that has a positive one."""
    top = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), "item", "as_of"))).where(F.col("_r") <= k)  # the first k of each task go on
    gain = top.groupBy(group).agg(F.sum(F.col(label).cast("int") / F.log2(F.col("_r") + 1)).alias("_g"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_p").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    whole = rows.groupBy(group).agg(F.count_if(label).alias("_p")).where("_p > 0").select(group, ideal.alias("_i"))
    return gain.join(whole, group).agg(F.count("*").alias("groups"), rounded(F.avg(F.col("_g") / F.col("_i")), 4).alias("ndcg"))


def listwise_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG by month on held-out items: a ranker trained on it, and the classifier's probability."""
    rows = _split(spark, sf_dir).withColumn("month", F.date_trunc("month", "as_of").cast("date"))
    train, held = rows.where("fold <> 'validation'"), rows.where("fold = 'validation'")
    ranker = boosting.ranking_trees(train, FEATURES, "success", "month")
    model = R.fit_classifier(train, FEATURES, "success")
    scored = saved(ranker.score(R.probabilities(model, held, FEATURES), "ranker"))
    found = [group_ndcg(scored, c, "success", "month", 10).select(F.lit(n).alias("model"), "*") for c, n in (("ranker", "listwise"), ("probability", "classifier"))]
    return found[0].unionByName(found[1])


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each of five purged folds, with AUC, its interval over items, and lift at a tenth."""
    rows = backtest_rows(spark, sf_dir).select("item", "as_of", "success", *FEATURES)
    rows = saved(rows)
    scored = saved(walkforward.walk_forward(rows, FEATURES, "success", "as_of", walkforward.even_folds(rows, "as_of", 5)))
    area, lift = E.auc(scored, "score", "success", ["fold"]), E.lift_at(scored, "score", "success", ["fold"])
    ends = E.bootstrap_interval(scored, "score", "success", "item", "fold")
    out = area.join(lift, "fold").join(ends, "fold", "left")
    return out.select("fold", "n", "positives", "auc", rounded(F.col("low"), 4).alias("low"), rounded(F.col("high"), 4).alias("high"), "lift")


QUERIES = {
    "isotonic_probabilities": isotonic_probabilities, "lift_by_slice": lift_by_slice, "calibrated_classifier": calibrated_classifier,
    "boosted_quantiles": boosted_quantiles, "listwise_ranker": listwise_ranker, "walk_forward": walk_forward,
}

SQL = {
    # the isotonic fit as max over starts of min over ends of the mean between
    "isotonic_probabilities": f"""WITH {_S}, g AS (SELECT score AS s, count(*) AS n, count(*) FILTER (WHERE toxic) AS p FROM sc WHERE score IS NOT NULL GROUP BY 1),
      c AS (SELECT *, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) AS cn, sum(p) OVER (ORDER BY s) AS cp FROM g),
      m AS (SELECT a.i AS j, b.i AS k, CAST(b.cp - a.cp + a.p AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM c a JOIN c b ON b.i >= a.i),
      f AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM m),
      v AS (SELECT k AS i, max(low) AS value FROM f GROUP BY 1)
      SELECT {r("min(s)", 6)} AS lo, {r("max(s)", 6)} AS hi, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS pos, {r("sum(p) / sum(n)", 6)} AS rate FROM c JOIN v USING (i) GROUP BY value""",
    "lift_by_slice": f"""WITH {_S}, x AS (SELECT * FROM sc WHERE score IS NOT NULL), t AS (SELECT lang, count(*) AS n, CAST(ceil(count(*) * 0.1) AS BIGINT) AS taken, count(*) FILTER (WHERE toxic) AS pos FROM x GROUP BY 1),
      g AS (SELECT lang, score, count(*) AS k, count(*) FILTER (WHERE toxic) AS p FROM x GROUP BY 1, 2),
      o AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
      w AS (SELECT lang, n, taken, pos, sum(p * greatest(0, least(k, taken - before)) / k) AS wins FROM o JOIN t USING (lang) GROUP BY ALL)
      SELECT lang, n, taken, {r("wins / taken", 6)} AS precision, CASE WHEN pos > 0 THEN {r("wins / taken / (pos / n)", 4)} END AS lift FROM w""",
}
