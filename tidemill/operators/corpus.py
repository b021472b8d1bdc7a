"""Training corpora: labels by tier, caps, splits, folds, fingerprints, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.rounding import rounded
from tidemill.operators.ranking import least_rows, null_safe, positions


def newest(df: DataFrame, key: list[str], order: str | Column) -> DataFrame:
    """The newest row of each key, by a grouped maximum instead of a sort."""
    values = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def enqueue_checkpoints(survivors: DataFrame, days: tuple[int, ...] = (30, 60)) -> DataFrame:
    """A row for each survivor and checkpoint day with the day that it is due; other columns are frozen as they are."""
    out = survivors.withColumn("checkpoint_day", F.explode(F.array(*map(F.lit, days))))
    return out.withColumn("due_at", F.date_add("enqueued_at", F.col("checkpoint_day"))).withColumn("status", F.lit("pending"))


def recheck(pending: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """Due checkpoints with the newest snapshot of their item: ``price_now`` and ``profit_now``; others stay pending."""
    fresh = newest(snapshots.select("item", "snapshot_day", "price"), ["item"], "snapshot_day").withColumnsRenamed({"price": "price_now"})
    out = pending.join(fresh, "item", "left")
    done = (F.col("due_at") <= now) & F.col("price_now").isNotNull() & (F.col("snapshot_day") >= F.col("due_at"))
    profit = rounded(F.col("price_now") * 0.6 - F.col("landed_cost"), 2)
    return out.withColumn("status", F.when(done, "done").otherwise("pending")).withColumn("profit_now", F.when(done, profit))


def outcome_label(would_rebuy: Column, profit: Column, tanked: Column) -> Column:
    """The buyer's word, else a profit without a fallen price."""
    return F.coalesce(would_rebuy, (profit > 0) & ~F.coalesce(tanked, F.lit(False)))


def match_key(ident: Column, name: Column) -> Column:
    """Upper-cased id, else lower-cased name, trimmed; null if neither is there."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.upper(clean(ident)), F.lower(clean(name)))


def decision_label(decision: Column) -> Column:
    """A person's decision as a label: bought is good, passed on is not; a deferred one says nothing."""
    return F.when(decision == "buy", True).when(decision == "pass", False)


def ledger_labels(ledger: DataFrame) -> DataFrame:
    """(``key, at, label``): the newest decision on each key of a ledger (``item, name, at, decision``), as
    ``read_ledger`` gives it. Lines without a key, or whose decision is none of buy and pass, give none."""
    rows = ledger.select(match_key(F.col("item"), F.col("name")).alias("key"), "at", decision_label(F.lower(F.trim("decision"))).alias("label"))
    return newest(rows.where("key is not null and label is not null"), ["key"], "at")


def assemble_tiers(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(``key, label, tier``): the newest outcome of each key is silver; keys without any have their newest decision as
    bronze. Both: ``key, at, label``, where ``at`` orders them; rows without a key or label are left out."""
    known = lambda df: df.where("key is not null and label is not null")
    silver = newest(known(outcomes).select("key", "at", "label"), ["key"], "at")
    bronze = newest(known(decisions).join(silver.select("key"), "key", "left_anti").select("key", "at", "label"), ["key"], "at")
    tier = lambda df, name: df.select("key", "label", F.lit(name).alias("tier"))
    return tier(silver, "silver").unionByName(tier(bronze, "bronze"))


def undecided(picks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items of ``picks`` (``item, id, category``) on which nobody decided, each with its first known category."""
    rows = picks.join(decisions.select("item").distinct(), "item", "left_anti")
    return rows.groupBy("item").agg(F.min_by("category", F.when(F.col("category").isNotNull(), F.col("id"))).alias("category"))


def weak_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """A weighted sum of components in 0..1; a missing one counts 0."""
    total = None
    for value, weight in parts.values():
        term = weight * F.coalesce(value, F.lit(0.0))
        total = term if total is None else total + term
    return rounded(total, 4)


def prefer_strong(labels: DataFrame) -> DataFrame:
    """One row of each item: a strong label beats a weak one, then the latest end date; strong ones weigh 3."""
    good = labels.where(~F.coalesce("censored", F.lit(False)))
    order = F.struct(F.col("strong").cast("int").alias("s"), "end_date", "seq")
    return newest(good.withColumn("_o", order), ["item"], "_o").drop("_o").withColumn("weight", F.when(F.col("strong"), 3.0).otherwise(1.0))


def hash_share(key: Column) -> Column:
    """A number in [0, 1) with three digits from the key's sha256."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(1000)) / 1000


def split_by_item(df: DataFrame, key: str = "item", share: float = 0.3) -> DataFrame:
    return df.withColumn("fold", F.when(hash_share(F.col(key)) < share, "validation").otherwise("train"))


def split_by_time(df: DataFrame, day: str, key: str, share: float = 0.3) -> DataFrame:
    """The latest ``max(1, round(share * n))`` of the n rows with a day, by (day, key), are for validation; rows without
    a day train.

    Rows are counted by day, so only the day that holds the bound is ranked; there is no window over all rows.
    """
    counts = df.where(F.col(day).isNotNull()).groupBy(day).count()
    n = counts.agg(F.sum("count")).first()[0] or 0
    want = max(1, round(n * share))
    later = counts.select(day, F.coalesce(F.sum("count").over(W.orderBy(F.desc(day)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_later"), "count")
    edge = later.where((F.col("_later") < want) & (F.col("_later") + F.col("count") >= want)).first()
    if edge is None:
        return df.withColumn("fold", F.lit("train"))
    bound, left = edge[day], want - edge["_later"]
    on_edge = F.col(day).eqNullSafe(F.lit(bound))
    rank = F.row_number().over(W.partitionBy(day).orderBy(F.desc(key)))
    ranked = df.where(on_edge).withColumn("fold", F.when(rank <= left, "validation").otherwise("train"))
    rest = df.where(~on_edge).withColumn("fold", F.when(F.col(day) > F.lit(bound), "validation").otherwise("train"))
    return rest.unionByName(ranked)


def purged_folds(df: DataFrame, day: str, bounds: DataFrame, embargo: int = 60) -> DataFrame:
    """Walk-forward folds (``fold, start, stop``): rows of [start, stop) are tested, rows that end ``embargo`` days
    before the start train, rows between are purged. A row is in several folds."""
    both = df.join(F.broadcast(bounds), F.col(day) < F.col("stop"))  # a handful of folds
    train = F.col(day) < F.date_sub("start", embargo)
    return both.withColumn("role", F.when(F.col(day) >= F.col("start"), "test").when(train, "train")).where("role is not null")


def cap_groups(df: DataFrame, by: str, limit: int, tie: list[str]) -> DataFrame:
    """At most ``limit`` rows of each group, exactly those with the least hash; rows without a group are one group."""
    key = F.conv(F.substring(F.sha2(F.concat_ws("|", *tie), 256), 1, 8), 16, 10).cast("long")
    return least_rows(df, [by], key, limit, tie)


def corpus_caps(df: DataFrame, tie: list[str], category: str = "category", brand: str = "brand") -> DataFrame:
    """Caps each category, then each brand, at a share of the original number of rows; a lone group isn't capped."""
    n = df.count()
    for by, share in ((category, D.CATEGORY_CAP), (brand, D.BRAND_CAP)):
        if df.select(by).distinct().limit(2).count() > 1:
            df = cap_groups(df, by, max(1, int(n * share)), tie)
    return df


def concentration(df: DataFrame, by: str, alarm: float) -> DataFrame:
    """How concentrated a dimension is: distinct values, shares of the largest and of the five largest, sum of squares."""
    counts = df.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))  # one row
    five = shares.orderBy(F.desc("n"), "value").limit(5).agg(rounded(F.sum("n") / F.max("total"), 4).alias("top5_share"))
    one = shares.agg(F.count("*").alias("distinct_values"), rounded(F.max("share"), 4).alias("top_share"), rounded(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"))
    out = one.crossJoin(F.broadcast(five)).withColumn("alarm", F.col("top_share") > alarm)
    return out.select(F.lit(by).alias("dimension"), "distinct_values", "top_share", "top5_share", "hhi", "alarm")


def tier_weight(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in D.TIER_WEIGHTS.items():
        out = F.when(tier == name, weight).otherwise(out)
    return out


def neutralise_mixed(df: DataFrame, live_only: list[str], tier: str = "tier") -> DataFrame:
    """Nulls the columns that only live tiers have if the rows are of several tiers."""
    mixed = df.select(tier).distinct().limit(2).count() > 1
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in live_only}) if mixed else df


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-insensitive digest of all rows: sums of row hashes by bucket, hashed; with the count and schema hash."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    hashed = df.select(row.alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 2).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.sum(F.conv(F.substring("h", 3, 8), 16, 10).cast("decimal(38,0)")).alias("a"),
        F.sum(F.conv(F.substring("h", 11, 8), 16, 10).cast("decimal(38,0)")).alias("b"),
    )
    text = F.concat_ws(":", "bucket", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    joined = F.array_join(F.sort_array(F.collect_list(text)), "|")  # 256 buckets at most
    return parts.agg(F.sum("n").alias("n_rows"), F.sha2(joined, 256).alias("content")).withColumn("schema_hash", F.sha2(F.lit(",".join(columns)), 256))


def interleave(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows in turn from each group: by position within the group, groups by first appearance. Rows without a group are
    one group."""
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    return null_safe(positions(df, order, [group], "turn"), first, [group]).orderBy("turn", "_first").drop("_first")


def waterfall(sources: list[DataFrame], target: int, key: str = "item") -> DataFrame:
    """Items of several sources in order of priority; the first source keeps an item; the first ``target`` of all."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(key, "pos").withColumn("source", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(key).agg(F.min(F.struct("source", "pos")).alias("b")).select(key, "b.source", "b.pos")
    return best.orderBy("source", "pos", key).limit(target)


def composition(df: DataFrame, source: str) -> DataFrame:
    """Rows of each source and their percent; unknown sources together."""
    counts = df.groupBy(F.coalesce(source, F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("source", "n", rounded(100 * F.col("n") / F.col("total"), 1).alias("percent"))  # one row


def resolve_queue(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision closes the newest pending row of its item and gives a label; a deferred one gives none."""
    order = F.row_number().over(W.partitionBy("item").orderBy(F.desc("created"), F.desc("id")))
    pending = queue.where("status = 'pending'").withColumn("_rn", order).where("_rn = 1").drop("_rn")
    label = F.when(F.col("decision") == "buy", True).when(F.col("decision") == "pass", False)
    return pending.join(newest(decisions, ["item"], "decided"), "item").withColumn("label", label).withColumn("status", F.lit("resolved"))


def attach_eligibility(survivors: DataFrame, cached: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Joins the freshest cached answer within ``days``: forbidden items are rejected, those to be approved are marked."""
    fresh = newest(cached.where(F.datediff(now, "fetched") <= days), ["item"], "fetched")
    out = survivors.join(fresh, "item", "left")
    return out.withColumn("rejected", F.coalesce(F.col("eligibility") == "NOT_ELIGIBLE", F.lit(False))).withColumn(
        "needs_approval", F.coalesce(F.col("eligibility") == "APPROVAL_REQUIRED", F.lit(False))
    )
