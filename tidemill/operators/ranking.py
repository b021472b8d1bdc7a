"""Positions and running sums inside groups of any size: rows are dealt to ordered buckets, so no group is sorted in
one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ordered buckets that the rows are dealt to.
PARTS = 64


def cuts(df: DataFrame, order: str) -> list[float]:
    """Approximate quantiles of a numeric column, which part it into PARTS buckets."""
    bounds = df.approxQuantile(order, [i / PARTS for i in range(1, PARTS)], 0.01)
    return sorted({b for b in bounds if b is not None})


def null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal columns ``by``, where nulls equal each other; the right one's columns ``by`` go."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = None
    for c in by:
        same = left[c].eqNullSafe(named[f"_r_{c}"])
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in by])


def running(df: DataFrame, order: str, values: list[str], by: list[str], descending: bool = False, bounds: list[float] | None = None) -> DataFrame:
    """Adds ``<value>_before``: sums over the rows of the group ``by`` that come earlier in the numeric ``order``.

    Sums of the buckets are few and are accumulated first; within a bucket a window goes on from there. Null groups
    are groups; rows without an ``order`` come first, or last if ``descending``.
    """
    bounds = cuts(df, order) if bounds is None else bounds
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    at = F.coalesce(at, F.lit(-1))
    rows = df.withColumn("_bucket", -at if descending else at)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    whole = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(whole), F.lit(0)).alias(f"_b_{v}") for v in values])
    inner = W.partitionBy(*by, "_bucket").orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_first(order)).rowsBetween(W.unboundedPreceding, -1)
    rows = null_safe(rows, totals, [*by, "_bucket"])
    for v in values:
        rows = rows.withColumn(f"{v}_before", F.col(f"_b_{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0))).drop(f"_b_{v}")
    return rows.drop("_bucket")


def positions(df: DataFrame, order: str, by: list[str], name: str) -> DataFrame:
    """Adds ``name``: each row's position (from 1) in its group by the numeric ``order``."""
    rows = running(df.withColumn("_one", F.lit(1)), order, ["_one"], by)
    return rows.withColumn(name, (F.col("_one_before") + 1).cast("int")).drop("_one", "_one_before")


def least_rows(df: DataFrame, by: list[str], key: Column, limit: int, tie: list[str], width: int = 4096, top: int = 1 << 32) -> DataFrame:
    """At most ``limit`` rows of each group, exactly those with the least ``key`` (an integer from 0 up to ``top``), then
    ``tie``. Rows are counted by group and slice of the key, so only the slice that holds the limit is ranked."""
    rows = df.withColumn("_k", key).withColumn("_slice", F.floor(F.col("_k") / (top // width)).cast("int"))
    counts = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_left", limit - before).where("_left > 0")
    near = null_safe(rows, counts, [*by, "_slice"])
    whole = near.where(F.col("_n") <= F.col("_left"))
    place = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_k", *tie))
    edge = near.where(F.col("_n") > F.col("_left")).withColumn("_place", place).where(F.col("_place") <= F.col("_left"))
    return whole.unionByName(edge.drop("_place")).select(*df.columns)
