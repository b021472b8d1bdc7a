"""Point-in-time features and labels of change-point series, by one sort per item.

A series has a row where a value changed: ``item, day`` and value columns, null when unknown or out of stock. Probes ask
for values strictly before a day. Points and probes are unioned and read through range frames over the day number that
end at -1, so a probe never sees a point of its own day, and no join of points with probes is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.rounding import rounded


def last_of_day(points: DataFrame, seq: str | None = None) -> DataFrame:
    """One point for each (item, day): the last by a sequence column."""
    if seq is None:
        return points
    values = [c for c in points.columns if c not in ("item", "day")]
    newest = points.groupBy("item", "day").agg(F.max_by(F.struct(*values), seq).alias("_v"))
    return newest.select("item", "day", "_v.*")


def simulation_dates(points: DataFrame, step: int = D.STEP_DAYS, horizon: int = D.HORIZON_DAYS, history: int = D.MIN_HISTORY_DAYS, value: str = "price") -> DataFrame:
    """``item, as_of``: every ``step`` days from ``history`` days after the first priced day while the last one is
    ``horizon`` days away."""
    priced = points.where(F.col(value).isNotNull())
    ends = priced.groupBy("item").agg(F.date_add(F.min("day"), history).alias("a"), F.date_sub(F.max("day"), horizon).alias("b"))
    return ends.where("a <= b").select("item", F.explode(F.expr(f"sequence(a, b, interval {step} days)")).alias("as_of"))


def _union(points: DataFrame, probes: DataFrame) -> DataFrame:
    marked = points.withColumn("_point", F.lit(True))
    asked = probes.select("item", F.col("as_of").alias("day")).distinct().withColumn("_point", F.lit(False))
    return marked.unionByName(asked, allowMissingColumns=True).withColumn("_n", F.unix_date("day"))


def _before(days: int | None = None) -> W:
    start = W.unboundedPreceding if days is None else -days
    return W.partitionBy("item").orderBy("_n").rangeBetween(start, -1)


def last_known(value: str) -> Column:
    """The last value before the probe that is not null."""
    return F.last(F.col(value), ignorenulls=True).over(_before())


def in_effect(value: str) -> Column:
    """The value of the last point before the probe, null if that point is."""
    point = F.when(F.col("_point"), F.col("_n"))
    return F.max_by(F.struct(F.col(value).alias("v")), point).over(_before())["v"]


def trailing_mean(value: str, days: int = D.MEAN_DAYS) -> Column:
    return rounded(F.avg(value).over(_before(days)), 3)


def unknown_share(value: str, days: int = D.MEAN_DAYS) -> Column:
    """Percent of the window's points whose value is null."""
    frame = _before(days)
    n = F.count(F.when(F.col("_point"), 1)).over(frame)
    unknown = F.count(F.when(F.col("_point") & F.col(value).isNull(), 1)).over(frame)
    return F.when(n > 0, rounded(100 * unknown / n, 1))


def count_drops(rows: DataFrame, value: str, alias: str, days: int = D.DROP_DAYS) -> DataFrame:
    """Adds how often consecutive known values inside the window fell; null with fewer than two of them."""
    earlier = F.last(F.col(value), ignorenulls=True).over(W.partitionBy("item").orderBy("_n", F.desc("_point")).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_fell", F.when(F.col(value).isNotNull(), F.coalesce(F.col(value) < earlier, F.lit(False)).cast("int")))
    frame = _before(days)
    inside = F.sum("_fell").over(frame) - F.first("_fell", ignorenulls=True).over(frame)
    return rows.withColumn(alias, F.when(F.count(value).over(frame) >= 2, inside)).drop("_fell")


def features_as_of(points: DataFrame, probes: DataFrame) -> DataFrame:
    """All features of each probe (``item, as_of``) from ``price, offers, sales_rank``, in one pass over each item."""
    rows = count_drops(_union(points, probes), "sales_rank", "rank_drops_30")
    rows = rows.withColumns(
        {
            "price_as_of": last_known("price"),
            "offers_as_of": last_known("offers").cast("long"),
            "rank_as_of": last_known("sales_rank").cast("long"),
            "avg_price_90": trailing_mean("price"),
            "avg_offers_90": trailing_mean("offers"),
            "oos_90": unknown_share("price"),
        }
    )
    names = ["price_as_of", "offers_as_of", "rank_as_of", "avg_price_90", "avg_offers_90", "oos_90", "rank_drops_30"]
    return rows.where(~F.col("_point")).select("item", F.col("day").alias("as_of"), *names)


def values_in_effect(points: DataFrame, probes: DataFrame, values: list[str]) -> DataFrame:
    """``item, as_of`` and each value as the last point before the probe had it, and that point's day."""
    rows = _union(points, probes).withColumns({f"{v}_in_effect": in_effect(v) for v in values})
    rows = rows.withColumn("last_point", F.max(F.when(F.col("_point"), F.col("day"))).over(_before()))
    return rows.where(~F.col("_point")).select("item", F.col("day").alias("as_of"), *[f"{v}_in_effect" for v in values], "last_point")


def outcomes_at_horizon(points: DataFrame, probes: DataFrame, horizon: int = D.HORIZON_DAYS, tolerance: int = D.TRACKING_TOLERANCE_DAYS) -> DataFrame:
    """Price and offers in effect ``horizon`` days after each probe; no row if the item's tracking ended more than
    ``tolerance`` days before that."""
    later = probes.select("item", F.date_add("as_of", horizon + 1).alias("as_of"))
    found = values_in_effect(points, later, ["price", "offers"])
    ends = points.groupBy("item").agg(F.max("day").alias("_end"))
    found = found.join(ends, "item").where(F.col("_end") >= F.date_sub("as_of", 1 + tolerance))
    return found.select("item", F.date_sub("as_of", horizon + 1).alias("as_of"), F.col("price_in_effect").alias("price_at_horizon"), F.col("offers_in_effect").alias("offers_at_horizon"))


def known_and_outcomes(points: DataFrame, probes: DataFrame, horizon: int = D.HORIZON_DAYS, tolerance: int = D.TRACKING_TOLERANCE_DAYS) -> DataFrame:
    """Price and offers last known before each probe, and those of ``outcomes_at_horizon``, from one sort of each item.

    Each probe is a row on its day and one behind its horizon, both ahead of the day's points, so all values are running
    ones. A value is in effect if it was known on the day of the last point."""
    ends = F.array(F.struct(F.col("as_of").alias("day"), F.lit(0).alias("_kind")), F.struct(F.date_add("as_of", horizon + 1).alias("day"), F.lit(1).alias("_kind")))
    asked = probes.select("item", "as_of", F.explode(ends).alias("_p")).select("item", "as_of", "_p.*")
    seen = points.where("day is not null").select("item", "day", F.lit(2).alias("_kind"), "price", "offers")
    rows = seen.unionByName(asked, allowMissingColumns=True).withColumn("_n", F.unix_date("day"))
    order = W.partitionBy("item").orderBy("_n", "_kind")
    so_far, whole = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    day = F.when(F.col("_kind") == 2, F.col("_n"))  # only points have prices or offers
    running = {f"_{v}": F.last(v, ignorenulls=True).over(so_far) for v in ("price", "offers")}
    running |= {f"_{v}_day": F.max(F.when(F.col(v).isNotNull(), F.col("_n"))).over(so_far) for v in ("price", "offers")}
    rows = rows.withColumns({**running, "_last": F.max(day).over(so_far), "_end": F.max(day).over(whole)})
    before, after = F.col("_kind") == 0, F.col("_kind") == 1
    known = [F.max(F.when(before, F.col(f"_{v}"))).alias(f"{v}_as_of") for v in ("price", "offers")]
    later = [F.max(F.when(after & (F.col(f"_{v}_day") == F.col("_last")), F.col(f"_{v}"))).alias(f"{v}_at_horizon") for v in ("price", "offers")]
    tracked = rows.where((F.col("_kind") < 2) & (F.col("_end") >= F.unix_date("as_of") + horizon - tolerance))
    return tracked.groupBy("item", "as_of").agg(*known, *later)  # rows of an item are in one task already


def simulated_outcomes(points: DataFrame, step: int = D.STEP_DAYS, horizon: int = D.HORIZON_DAYS, history: int = D.MIN_HISTORY_DAYS) -> DataFrame:
    """``known_and_outcomes`` at the ``simulation_dates`` of each item, from one pass over its points in order of day.

    What a probe sees is what held from a point until the next one. So the point itself tells which dates lie in that
    time, and which have their horizon there; probes are neither made beforehand nor sorted among the points. The dates
    end ``horizon`` days before the last priced day, so tracking has never ended too early. Points have one row a day."""
    order = W.partitionBy("item").orderBy("_n")
    so_far, whole = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    priced = F.when(F.col("price").isNotNull(), F.col("_n"))
    rows = points.where("day is not null").select("item", "price", "offers", F.unix_date("day").alias("_n")).withColumns(
        {
            **{f"_{v}": F.last(v, ignorenulls=True).over(so_far) for v in ("price", "offers")},
            "_next": F.lead("_n").over(order),
            "_first": F.min(priced).over(whole) + history,
            "_last": F.max(priced).over(whole) - horizon,
        }
    )

    def dates(ahead: int) -> tuple[Column, Column]:
        """The first and last number of a date that comes after the point's day and up to the next one's, ``ahead`` days later."""
        since, until = F.col("_n") - ahead, F.least(F.col("_next") - ahead, F.col("_last"))
        return F.greatest(F.lit(0), F.floor((since - F.col("_first")) / step) + 1), F.floor((until - F.col("_first")) / step)

    (from_known, to_known), (from_later, to_later) = dates(0), dates(horizon + 1)
    kinds = [(0, from_known, to_known, "_price", "_offers"), (1, from_later, to_later, "price", "offers")]
    held = F.array(*[F.struct(F.lit(k).alias("_kind"), a.alias("_from"), b.alias("_to"), F.col(p).alias("_p"), F.col(o).alias("_o")) for k, a, b, p, o in kinds])
    seen = rows.where((from_known <= to_known) | (from_later <= to_later)).select("item", "_first", F.explode(held).alias("_h")).select("item", "_first", "_h.*")
    seen = seen.where("_from <= _to").withColumn("_k", F.explode(F.sequence("_from", "_to")))
    seen = seen.withColumn("as_of", F.date_from_unix_date((F.col("_first") + F.col("_k") * step).cast("int")))
    names = {"price_as_of": (0, "_p"), "offers_as_of": (0, "_o"), "price_at_horizon": (1, "_p"), "offers_at_horizon": (1, "_o")}
    return seen.groupBy("item", "as_of").agg(*[F.max(F.when(F.col("_kind") == k, F.col(v))).alias(n) for n, (k, v) in names.items()])
