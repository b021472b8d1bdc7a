"""Weekly interest series, listing comparisons and daily-snapshot features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.rounding import rounded
from tidemill.operators.ranking import null_safe, running


def weekly_features(series: DataFrame) -> DataFrame:
    """Features of each (``term, week_start``) from weeks up to it: ``closed`` is the first day that may see them."""
    n = F.unix_date("week_start")
    by = W.partitionBy("term")
    recent = by.orderBy(n).rangeBetween(-90, 0)
    four = by.orderBy(n).rowsBetween(-3, 0)
    rows = series.withColumn("_week", F.weekofyear("week_start")).withColumn("_year", F.year("week_start"))
    ratio = F.col("interest") / F.nullif(F.avg("interest").over(recent), F.lit(0.0))
    count = F.count("*").over(four)
    slope = F.when(count >= 2, (F.col("interest") - F.first("interest").over(four)) / (count - 1))
    # the same week of other years: sums up to now without those of this year
    so_far = W.partitionBy("term", "_week").orderBy(n).rowsBetween(W.unboundedPreceding, 0)
    year = W.partitionBy("term", "_week", "_year").orderBy(n).rowsBetween(W.unboundedPreceding, 0)
    other = lambda c: F.sum(c).over(so_far) - F.sum(c).over(year)
    m = F.count("*").over(so_far) - F.count("*").over(year)
    mean = other(F.col("interest")) / m
    spread = other(F.col("interest") * F.col("interest")) / m - mean * mean
    z = F.when(m >= 2, F.when(spread > 1e-9, (F.col("interest") - mean) / F.sqrt(spread)).otherwise(0.0))
    out = rows.withColumns({"ratio": rounded(ratio, 3), "slope": rounded(slope, 3), "seasonal_z": rounded(z, 3)})
    return out.select("term", F.col("week_start").alias("latest"), F.date_add("week_start", D.WEEK_DAYS).alias("closed"), "ratio", "slope", "seasonal_z")


def trend_as_of(series: DataFrame, probes: DataFrame) -> DataFrame:
    """Trend features of each distinct (``term, as_of``): only weeks that have ended by then count."""
    weeks = weekly_features(series)
    asked = probes.select("term", F.col("as_of").alias("closed")).distinct().withColumn("_probe", F.lit(True))
    values = ["latest", "ratio", "slope", "seasonal_z"]
    rows = weeks.withColumn("_s", F.struct(*values)).select("term", "closed", "_s").unionByName(asked, allowMissingColumns=True)
    seen = F.last("_s", ignorenulls=True).over(W.partitionBy("term").orderBy(F.unix_date("closed")).rangeBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_v", seen).where("_probe").select("term", F.col("closed").alias("as_of"), "_v.*")
    stale = F.coalesce(F.datediff("as_of", "latest") > D.TREND_STALE_DAYS, F.lit(True))
    return rows.withColumn("spike", F.col("ratio") > D.TREND_SPIKE).withColumn("stale", stale).drop("latest")


def attach(rows: DataFrame, trend: DataFrame, key: str, prefix: str) -> DataFrame:
    """Adds the trend columns of a row's term and day under a prefix; without a trend it is stale."""
    named = trend.select(F.col("term").alias(key), "as_of", *[F.col(c).alias(f"{prefix}_{c}") for c in ("ratio", "slope", "seasonal_z", "spike", "stale")])
    return rows.join(named, [key, "as_of"], "left").withColumn(f"{prefix}_stale", F.coalesce(f"{prefix}_stale", F.lit(True)))


def backfill(old: DataFrame, fresh: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Old rows with newly computed columns where there are any; the other columns stay."""
    new = fresh.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = old.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def listing_comparison(items: DataFrame, listings: DataFrame) -> DataFrame:
    """Active listings of each code: how many, and their median price as a ratio of the item's own."""
    by = listings.where(F.col("price") > 0).groupBy("upc").agg(F.count("*").alias("listings"), F.percentile("price", F.lit(0.5)).alias("median"))
    return items.join(by, "upc", "left").withColumn("ratio", rounded(F.col("median") / F.when(F.col("price") > 0, F.col("price")), 3))


def snapshot_features(daily: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Features of each item from its snapshots (``item, day, rank, price, buybox, reviews, offers``) of the last days.

    The slope is taken over the days on which the rank is known.
    """
    recent = daily.where((F.col("day") >= F.date_sub(as_of, days)) & (F.col("day") <= as_of))
    t = F.datediff("day", F.lit("1970-01-01").cast("date"))
    ends = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("day"))) - F.min_by(c, F.when(F.col(c).isNotNull(), F.col("day")))
    mean_price, std_price = F.avg("price"), F.stddev_samp("price")
    return recent.groupBy("item").agg(
        rounded(F.avg("rank"), 3).alias("rank_mean"),
        rounded(F.stddev_samp("rank"), 3).alias("rank_std"),
        rounded(F.regr_slope("rank", t), 4).alias("rank_slope"),
        rounded(F.greatest(F.lit(0.0), 1 - std_price / F.nullif(mean_price, F.lit(0.0))), 4).alias("price_resilience"),
        ends("reviews").alias("review_velocity"),
        ends("offers").alias("offer_acceleration"),
        rounded(F.max_by("price", "day") - F.max_by("buybox", "day"), 2).alias("buybox_gap"),
    )


def category_percentile(rows: DataFrame, category: str, rank: str) -> DataFrame:
    """The share of a category's rows with a strictly worse rank, one half where the rank is unknown. Ranks are counted
    by category and value, so a category isn't sorted in one task."""
    counts = rows.where(F.col(rank).isNotNull()).groupBy(category, rank).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(category).agg(F.sum("_n").alias("_all"))
    shares = null_safe(running(counts, rank, ["_n"], [category]), totals, [category])
    shares = shares.select(category, rank, rounded(1 - (F.col("_n_before") + F.col("_n")) / F.col("_all"), 4).alias("_share"))
    return null_safe(rows, shares, [category, rank], "left").withColumn("percentile", F.coalesce("_share", F.lit(0.5))).drop("_share")


def closed_weeks(rows: DataFrame) -> DataFrame:
    """Weekly points without those that are partial or empty."""
    return rows.where(~F.coalesce("partial", F.lit(False)) & F.col("interest").isNotNull())


def storefront(rows: DataFrame, most: int = 50) -> DataFrame:
    """One row a seller and day: how many items, and the first ``most`` of them by id, which every task finds for itself
    before the shuffle; a seller's other items are only counted."""
    items = rows.select("seller", "day", "item").distinct()
    place = F.row_number().over(W.partitionBy("seller", "day").orderBy("item"))
    first = items.where(F.col("item").isNotNull()).withColumn("_n", place).where(F.col("_n") <= most)
    first = first.groupBy("seller", "day").agg(F.array_sort(F.collect_list("item")).alias("items"))
    counts = items.groupBy("seller", "day").agg(F.count("item").cast("int").alias("n_items"))
    out = null_safe(counts, first, ["seller", "day"], "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(out.schema["items"].dataType)))
