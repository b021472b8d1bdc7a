"""Operational reports over leads, events and inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.rounding import rounded


def sell_through(outcomes: DataFrame) -> DataFrame:
    """Mean share sold, turns a year of what sold out, and the mean gap of estimated and actual return; one row."""
    share = F.when(F.col("bought") > 0, F.col("sold") / F.col("bought"))
    days = F.when(F.col("sold") >= F.col("bought"), F.col("days_to_sell"))
    return outcomes.agg(
        rounded(F.avg(share), 4).alias("sell_through"),
        rounded(365 / F.nullif(F.avg(days), F.lit(0.0)), 2).alias("turns"),
        rounded(F.avg(F.col("est_roi") - F.col("roi")), 4).alias("roi_gap"),
    )


def check_stats(leads: DataFrame) -> DataFrame:
    """Wins and losses by each scored check's result and each adjustment; suggests a change on four or more rows of
    which three quarters lost."""
    checks = F.transform("checks", lambda c: F.concat(F.lit("check:"), c["name"], F.when(c["passed"], "=pass").otherwise("=fail")))
    moves = F.transform("adjustments", lambda a: F.concat(F.lit("adjustment:"), a["name"]))
    rows = leads.where("won is not null").select("won", F.explode(F.concat(checks, moves)).alias("key"))
    out = rows.groupBy("key").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))
    n = F.col("wins") + F.col("losses")
    return out.withColumn("suggest", (n >= 4) & (F.col("losses") / n >= 0.75))


def proposals(stats: DataFrame, flagged_brands: DataFrame) -> DataFrame:
    """Findings to act on: factors that mostly lose, checks without effect, brands flagged twice or more."""
    n = F.col("wins") + F.col("losses")
    trust = F.when(n >= 20, "high").when(n >= 8, "medium").otherwise("low")
    losing = stats.where("suggest").select(F.lit("loss-rate").alias("kind"), F.col("key").alias("subject"), n.alias("n"), trust.alias("confidence"))
    toothless = stats.where((n >= 5) & (F.col("wins") == 0) & F.col("key").startswith("check:")).select(F.lit("toothless").alias("kind"), F.col("key").alias("subject"), n.alias("n"), trust.alias("confidence"))
    brands = flagged_brands.groupBy("brand").agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("brand").alias("kind"), F.col("brand").alias("subject"), "n", trust_of("n").alias("confidence"))
    return losing.unionByName(toothless).unionByName(brands)


def trust_of(n: str) -> Column:
    return F.when(F.col(n) >= 20, "high").when(F.col(n) >= 8, "medium").otherwise("low")


def memory_split(rows: DataFrame, least: int = 15) -> DataFrame:
    """Hit rate of disagreements with and without memory, where each has enough of them."""
    out = rows.where("disagrees").groupBy("memory_used").agg(F.count("*").alias("n"), rounded(F.avg(F.col("hit").cast("int")), 4).alias("rate"))
    return out.withColumn("enough", F.col("n") >= least)


def daily_dashboard(events: DataFrame, kinds: list[str]) -> DataFrame:
    """New rows by day and kind over a full spine of days, cumulative, last seven days, and against the seven before."""
    daily = events.groupBy("day").pivot("kind", kinds).count().na.fill(0)
    ends = events.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select(F.explode(F.expr("sequence(a, b)")).alias("day"))
    rows = spine.join(daily, "day", "left").na.fill(0).withColumn("n", sum((F.col(k) for k in kinds), F.lit(0)))
    first = events.groupBy("entity").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("new_entities"))
    rows = rows.join(first, "day", "left").na.fill(0)
    ordered = W.orderBy(F.unix_date("day"))  # one row a day
    return rows.withColumns(
        {
            "cumulative": F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, 0)),
            "week": F.sum("n").over(ordered.rangeBetween(-6, 0)),
            "trend": F.sum("n").over(ordered.rangeBetween(-6, 0)) - F.coalesce(F.sum("n").over(ordered.rangeBetween(-13, -7)), F.lit(0)),
        }
    )


def run_stats(runs: DataFrame, since: Column) -> DataFrame:
    """Runs by status and their mean tokens since a day."""
    return runs.where(F.col("day") >= since).groupBy("status").agg(F.count("*").alias("n"), rounded(F.avg("tokens"), 2).alias("mean_tokens"), F.count_if(F.col("balance") < 0).alias("negative"))


def open_commitments(leads: DataFrame) -> DataFrame:
    """Money in bought leads that have no outcome; one row."""
    held = leads.where("decision = 'buy' and closed is null")
    return held.agg(F.count("*").alias("n"), rounded(F.sum((F.col("cost") * F.coalesce("bought", "suggested", F.lit(1))).cast("decimal(18,2)")).cast("double"), 2).alias("committed"))


def aged_inventory(items: DataFrame, today: Column) -> DataFrame:
    """Days held, age tier, and whether to cut losses."""
    a, b, c = D.AGED_TIERS
    days = F.datediff(today, "received")
    tier = F.when(days >= c, "surcharge").when(days >= b, "red").when(days >= a, "amber").otherwise("ok")
    return items.withColumn("days", days).withColumn("tier", tier).withColumn("cut_loss", (days >= D.CUT_LOSS_DAYS) & (F.col("left_units") > 0) & (F.col("margin") <= 0))


def latest_status(ledger: DataFrame, proposals: DataFrame) -> DataFrame:
    """The last action on each proposal, pending if there is none."""
    last = ledger.groupBy("proposal").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"))
    return proposals.join(last, "proposal", "left").withColumn("status", F.coalesce("action", F.lit("pending"))).drop("action")


def health_alerts(runs: DataFrame) -> DataFrame:
    """One row for each alarm that a day's run raises."""
    alarms = F.filter(
        F.array(
            F.when(F.col("status") == "failed", "run failed"),
            F.when(F.col("drifted"), "snapshot drift"),
            F.when(F.col("balance") < 100, "low balance"),
            F.when(F.col("mismatches") > 0, "integrity mismatch"),
        ),
        lambda a: a.isNotNull(),
    )
    return runs.select("day", F.explode(alarms).alias("alert"))


def inventory_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("owned").alias("owned"), F.sum("warehouse").alias("warehouse"), F.sum("transit").alias("transit"), F.count_if(F.lower("note").contains("low")).alias("low_stock"))


def watch_summary(deals: DataFrame, n: int = 8) -> DataFrame:
    """Deals by signal with their best discount, and the ``n`` best finds; both as rows of one table."""
    by_signal = deals.groupBy("signal").agg(F.count("*").alias("n"), F.max("discount").alias("best"))
    top = deals.orderBy(F.desc_nulls_last("discount"), "id").limit(n)
    return by_signal.select(F.lit("signal").alias("kind"), F.col("signal").alias("ref"), "n", "best").unionByName(
        top.select(F.lit("find").alias("kind"), F.col("id").cast("string").alias("ref"), F.lit(1).cast("long").alias("n"), F.col("discount").alias("best"))
    )
