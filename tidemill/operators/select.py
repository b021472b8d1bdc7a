"""Selection of candidates: filters, ranks, queues, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.rounding import rounded


def discover(catalogue: DataFrame, limit: int, price=(8, 60), max_rank=200000, offers=(3, 25), max_weight=5.0, min_sales=50, order: str = "est_sales") -> DataFrame:
    """Catalogue rows inside all ranges, the first ``limit`` by ``order`` descending (a take-ordered, no full sort)."""
    inside = F.col("price").between(*price) & (F.col("sales_rank") <= max_rank) & F.col("offers").between(*offers)
    inside &= (F.col("weight_lb") <= max_weight) & (F.col("est_sales") >= min_sales)
    return catalogue.where(inside).orderBy(F.desc(order), "item").limit(limit)


def new_winners(scored: DataFrame, picked: DataFrame, n: int, threshold: float = D.SCORE_THRESHOLD, rank: Column | None = None) -> DataFrame:
    """Candidates that no gate rejects and that reach the threshold, without those picked before; the best ``n``."""
    rank = F.col("score") if rank is None else rank
    good = scored.where(F.col("hard_reject").isNull() & (F.col("score") >= threshold)).withColumn("rank_key", rank)
    fresh = good.join(picked.select("item").distinct(), "item", "left_anti")
    return fresh.orderBy(F.desc_nulls_last("rank_key"), "item").limit(n)


def route(scored: DataFrame, probability: Column, alert: float = 0.70, uncertain: tuple[float, float] = (0.45, 0.65)) -> DataFrame:
    """Second-generation routing: gated rows are rejected, uncertain ones reviewed, sure ones alerted, others skipped."""
    lane = (
        F.when(F.col("hard_reject").isNotNull(), "reject")
        .when(probability.between(*uncertain), "review")
        .when(probability >= alert, "alert")
        .otherwise("skip")
    )
    return scored.withColumn("probability", probability).withColumn("lane", lane)


def min_max(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Scales a column to 0..1 by its extremes over all rows, 0.5 if they are equal. The extremes are one row."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return df.withColumn(alias, F.when(F.col(value).isNotNull(), 0.5))
    return df.withColumn(alias, rounded((F.col(value) - ends["lo"]) / (ends["hi"] - ends["lo"]), 4))


def review_queue(leads: DataFrame, decided: DataFrame, matches: DataFrame) -> DataFrame:
    """Undecided leads by scaled worth (``profit`` times ``sales``), with pending matches by their doubt."""
    open_leads = leads.join(decided.select("id").distinct(), "id", "left_anti").withColumn("worth", F.col("profit") * F.col("sales"))
    first = min_max(open_leads, "worth", "priority").select(F.lit("lead").alias("kind"), F.col("id").cast("string").alias("ref"), "priority")
    second = matches.where("status = 'pending'").select(F.lit("match").alias("kind"), F.col("id").cast("string").alias("ref"), rounded(1 - F.col("confidence"), 4).alias("priority"))
    return first.unionByName(second)


def recent_brands(*tables: DataFrame, limit: int) -> DataFrame:
    """Brands of several tables (``brand, seen``), each once whatever its case, in the newest spelling, newest first."""
    rows = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        rows = rows.unionByName(t.withColumn("_t", F.lit(i)))
    key = F.lower("brand")
    best = rows.groupBy(key.alias("key")).agg(F.max(F.struct("seen", (-F.col("_t")).alias("t"), "brand")).alias("b"))
    return best.select("key", F.col("b.brand").alias("brand"), F.col("b.seen").alias("seen")).orderBy(F.desc("seen"), "key").limit(limit)


def due(runs: DataFrame, now: Column, every_days: Column) -> DataFrame:
    """Searches that never ran or ran ``every_days`` (21 if unknown) or more ago."""
    gap = F.datediff(now, F.col("last_run"))
    return runs.where(F.col("last_run").isNull() | (gap >= F.coalesce(every_days, F.lit(21))))


def axes(index: Column, sizes: list[int]) -> list[Column]:
    """Splits a running number into digits of mixed base, the last axis fastest."""
    out, rest = [], index
    for size in reversed(sizes):
        out.append(F.pmod(rest, F.lit(size)))
        rest = F.floor(rest / size)
    return out[::-1]


def rotation_day(key: Column, days: int = 7) -> Column:
    """The weekday of a source: its md5 as a 128-bit number modulo ``days``, by halves that fit a long."""
    digest = F.md5(key)
    part = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    out = F.lit(0).cast("long")
    for i in (1, 9, 17, 25):
        out = (out * ((1 << 32) % days) + part(i)) % days
    return out


def yields(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs, pages and items of each combination; dry after three runs and pages without an item."""
    out = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("pages").alias("pages"), F.sum("items").alias("items"))
    return out.withColumn("dry", (F.col("runs") >= 3) & (F.col("pages") >= 3) & (F.col("items") == 0))


def recent_pool(seen: DataFrame, exclude: str, keep: int) -> DataFrame:
    """The distinct sellers by first sighting without ``exclude``, the last ``keep`` of them."""
    first = seen.where(F.col("seller") != exclude).groupBy("seller").agg(F.min("pos").alias("pos"))
    return first.orderBy(F.desc("pos")).limit(keep)


def brand_history(leads: DataFrame) -> DataFrame:
    """Leads, decisions and outcomes of each brand, whatever its case."""
    by = leads.groupBy(F.lower("brand").alias("brand"))
    wins = F.count_if(F.coalesce(F.col("profit") > 0, F.lit(False))).alias("wins")
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in ("buy", "pass", "defer")]
    return by.agg(F.count("*").alias("leads"), *counts, F.count("closed").alias("outcomes"), wins)


def active_brands(leads: DataFrame, since: Column) -> DataFrame:
    """Brands with a lead or an outcome since a day."""
    return leads.where((F.col("created") >= since) | (F.col("closed") >= since)).select("brand").distinct()


def top_by_triage(leads: DataFrame, n: int) -> DataFrame:
    """The best leads by exact triage score, else by the approximate one; unknown ones last."""
    key = F.coalesce("triage", "approx")
    return leads.withColumn("rank_key", key).orderBy(F.desc_nulls_last("rank_key"), "id").limit(n)


def numbered(df: DataFrame, by: list[str], order: list[Column], alias: str = "rn") -> DataFrame:
    return df.withColumn(alias, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
