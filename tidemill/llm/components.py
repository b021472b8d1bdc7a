"""Connected components of a link table, by joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import HOT_ROWS, HOT_SHARE, ROWS_A_TASK, saved_round

MAX_ROUNDS = 60


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _with_least(rows: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``rows`` (``a``, ``b``) with the least id ``m`` near ``a`` (``least``, saved: ``a, m, n``, with n rows of each a).

    The links of a hot id are dealt by their other end, and its least id goes to each part. There are at most
    2 * HOT_SHARE hot ids, since each has more than a HOT_SHARE-th of the links, so they are broadcast.
    """
    limit = max(HOT_ROWS, n_links // HOT_SHARE)
    hot = least.where(F.col("n") > limit).select("a", F.ceil(F.col("n") / limit).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(least.select("a", "m"), "a")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), "a", "left").select("a", "b", part.alias("_part"))
    every = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / limit).cast("int"), F.lit(1)) - 1)
    return dealt.join(least.select("a", "m", F.explode(every).alias("_part")), ["a", "_part"]).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) to (``id``, ``component``): each linked id with the smallest id that it reaches.

    Alternating star contraction: every id first hands its larger neighbours, then its smaller ones, to the smallest id
    near it, until each component is one star. Neighbours are never gathered: each step is a grouped minimum, which is
    pre-aggregated, and a join that deals the links of hot ids over several tasks. Each round's links are written to the
    shared checkpoint folder. The rounds grow with the logarithm of the longest chain. Null ends are no links; repeated
    links are one; an empty table gives an empty result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = saved_round(links)
    before = _signature(links)
    if not before[0]:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    parts = -(-before[0] // ROWS_A_TASK)  # links never grow in number beyond two for each id
    links = links.coalesce(parts)
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved_round(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).coalesce(parts))
        large = _with_least(both.where("b > a"), least, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved_round(large.coalesce(parts))
        least = saved_round(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(parts))
        small = _with_least(large, least, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        links = saved_round(small.where("a <> b").distinct().coalesce(parts))
        now = _signature(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links didn't settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
