"""Calendar features: holidays by rule, recurring windows, weekday flags, season chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (name, kind, month, n, weekday with Monday 0). ``fixed``: day n; ``nth``: n-th weekday; ``last``: last
#: weekday; ``after``: the day after the named n-th weekday.
HOLIDAYS = [
    ("new_year", "fixed", 1, 1, 0),
    ("valentines", "fixed", 2, 14, 0),
    ("mothers_day", "nth", 5, 2, 6),
    ("memorial_day", "last", 5, 0, 0),
    ("fathers_day", "nth", 6, 3, 6),
    ("independence_day", "fixed", 7, 4, 0),
    ("labor_day", "nth", 9, 1, 0),
    ("halloween", "fixed", 10, 31, 0),
    ("thanksgiving", "nth", 11, 4, 3),
    ("black_friday", "after", 11, 4, 3),
    ("christmas", "fixed", 12, 25, 0),
]


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``name, day`` of every rule in every year: a small dimension, rules times years."""
    rules = spark.createDataFrame(HOLIDAYS, "name string, kind string, month int, n int, wd int")
    rows = rules.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    start = F.make_date("year", "month", F.lit(1))
    first = F.date_add(start, F.pmod(F.col("wd") - F.weekday(start), F.lit(7)))
    nth = F.date_add(first, (F.col("n") - 1) * 7)
    end = F.last_day(start)
    last = F.date_sub(end, F.pmod(F.weekday(end) - F.col("wd"), F.lit(7)))
    day = (
        F.when(F.col("kind") == "fixed", F.date_add(start, F.col("n") - 1))
        .when(F.col("kind") == "nth", nth)
        .when(F.col("kind") == "last", last)
        .otherwise(F.date_add(nth, 1))
    )
    return rows.select("name", day.alias("day"))


def nearest_holiday(dates: DataFrame, dim: DataFrame, column: str = "day") -> DataFrame:
    """For each distinct date: signed days to the nearest holiday (positive: ahead), the earlier one on ties.

    The dimension has a few hundred rows; dates are distinct before the join, so the product stays small.
    """
    days = dates.select(F.col(column).alias("as_of")).distinct()
    near = dim.select(F.col("day").alias("_h"), "name")
    # a holiday is never farther than the neighbouring years' ones: join on the year, widened by one each way
    near = near.withColumn("_y", F.explode(F.array(*[F.year("_h") + i for i in (-1, 0, 1)])))
    joined = days.withColumn("_y", F.year("as_of")).join(F.broadcast(near), "_y")  # rules times years rows
    gap = F.datediff("_h", "as_of")
    best = F.min(F.struct(F.abs(gap).alias("d"), F.col("_h").alias("h"), "name")).alias("b")
    return joined.groupBy("as_of").agg(best).select("as_of", F.datediff("b.h", "as_of").alias("days_to_holiday"), F.col("b.name").alias("holiday"))


def days_to_window(day: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Days to the next start of a yearly window, not positive inside it; after its end the next year's counts."""
    this_end = F.make_date(F.year(day), F.lit(end[0]), F.lit(end[1]))
    year = F.year(day) + F.when(day > this_end, 1).otherwise(0)
    return F.datediff(F.make_date(year, F.lit(start[0]), F.lit(start[1])), day)


def weeks_to_deadline(day: Column, deadline: tuple[int, int]) -> Column:
    days = days_to_window(day, deadline, deadline)
    return F.round((days / 7).cast("decimal(18,6)"), 1).cast("double")


def season_chips(day: Column) -> Column:
    """Labels of the seasons that a date is in."""
    week, month = F.weekofyear(day), F.month(day)
    to_q4 = days_to_window(day, (10, 15), (10, 15))
    return F.array_compact(
        F.array(
            F.when((month >= 7) & (month <= 8), "back-to-school"),
            F.when(week >= 40, "q4"),
            F.when((to_q4 >= 0) & (to_q4 <= 45), "q4-inbound"),
            F.when(month == 1, "clearance"),
            F.when((month >= 3) & (month <= 5), "spring"),
        )
    )
