"""Deals: hints, matching to a catalogue, application of matches, source health."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import defaults as D
from tidemill.functions.rounding import rounded
from tidemill.sources.folders import saved, spread


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of lower-cased titles. For candidate pairs only: it is quadratic in the titles."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


def price_sane(deal: Column, candidate: Column) -> Column:
    return F.coalesce(candidate / F.when(deal > 0, deal) <= D.MAX_PRICE_RATIO, F.lit(True)) | F.coalesce(candidate == 0, F.lit(False))


def agreement(deal: Column, candidate: Column) -> tuple[Column, Column, Column]:
    """Brand, pack and size agreement of two attribute structs; null if a side doesn't say."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    brand = clean(deal["brand"]) == clean(candidate["brand"])
    pack = deal["pack"].eqNullSafe(candidate["pack"])
    size = F.when(deal["size"].isNotNull() & candidate["size"].isNotNull(), deal["unit"].eqNullSafe(candidate["unit"]) & (F.abs(deal["size"] - candidate["size"]) < 1e-6))
    return brand, pack, size


def confidence(by_code: Column, brand: Column, pack: Column, size: Column, similarity: Column, sane: Column) -> Column:
    """A known mismatch caps it at 0.1; a code with agreeing attributes gives 0.95; words alone never reach the band of
    automatic acceptance; an insane price takes three tenths away."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    no = lambda c: F.coalesce(~c, F.lit(False))
    share = F.when(yes(brand), 0.40).otherwise(0.15) + F.when(yes(pack), 0.35).otherwise(0.15) + F.when(yes(size), 0.25).otherwise(0.12)
    words = F.least(0.55 * similarity + 0.45 * share, F.lit(D.MATCH_AUTO - 0.05))
    value = F.when(by_code & yes(brand) & yes(pack), D.CODE_CONFIDENCE).otherwise(words)
    value = F.when(sane, value).otherwise(value * 0.7)
    mismatch = no(brand) | no(pack) | no(size)
    return F.when(mismatch, min(0.1, D.MATCH_VERIFY * 0.5)).otherwise(rounded(F.greatest(F.lit(0.0), F.least(value, F.lit(0.99))), 3))


def route(value: Column) -> Column:
    return F.when(value >= D.MATCH_AUTO, "auto").when(value >= D.MATCH_VERIFY, "review").otherwise("discard")


#: Sets, for each one asked for, that the rarest words may show at first.
RARE = 16


def _meet(words: DataFrame, sets: DataFrame) -> DataFrame:
    return words.select("b", "asked", "word").join(sets, ["b", "word"]).select("b", "asked", "held", "least")


def largest_overlaps(asked: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """For each set of words (``b, asked``) the ``most`` sets of the same ``b`` (``b, held, least``) that share most
    words, ties by ``least``: ``b, asked, held, overlap, least``. Sets that share none don't count. All sets are distinct.

    A set's words go from rare to common. The sets of its rarest words come first, RARE * ``most`` of them or so; the
    ``most``-th overlap among these, t, bounds the rest: a set that has none of the first words but the last t - 1 has a
    smaller overlap. So common words are only met where t leaves no choice. The commonest word is met by its first
    ``most`` sets alone: a set that shares nothing else ranks after them all."""
    posted = held.withColumn("word", F.explode("held"))
    often = posted.groupBy("b", "word").agg(F.count("*").alias("_df"))
    mine = W.partitionBy("b", "asked")  # the words of one set
    order = mine.orderBy("_df", "word")
    words = asked.select("b", "asked").distinct().withColumn("word", F.explode("asked")).join(often, ["b", "word"])
    words = words.withColumn("_at", F.row_number().over(order)).withColumn("_m", F.count("*").over(mine))
    so_far = F.sum("_df").over(order.rowsBetween(W.unboundedPreceding, 0))
    words = saved(words.withColumn("_first", (F.col("_at") == 1) | (so_far <= RARE * most)))
    few = posted.withColumn("_n", F.row_number().over(W.partitionBy("b", "word").orderBy("least"))).where(F.col("_n") <= most).drop("_n")
    lone = F.col("_m") == 1

    def counted(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().withColumn("overlap", F.size(F.array_intersect("asked", "held")))

    place = F.row_number().over(mine.orderBy(F.desc("overlap"), "least"))
    near = counted(_meet(words.where(F.col("_first") & ~lone), posted).unionByName(_meet(words.where(lone), few)))
    near = saved(near.withColumn("_n", place).where(F.col("_n") <= most).drop("_n"))
    bound = near.groupBy("b", "asked").agg(F.when(F.count("*") >= most, F.min("overlap")).otherwise(0).alias("_t"))
    rest = words.where(~F.col("_first")).join(bound, ["b", "asked"], "left").withColumn("_t", F.coalesce("_t", F.lit(0)))
    last = (F.col("_t") <= 1) & (F.col("_at") == F.col("_m"))
    full = ~last & (F.col("_at") <= F.col("_m") - F.greatest(F.col("_t"), F.lit(1)) + 1)
    more = counted(_meet(rest.where(full), posted).unionByName(_meet(rest.where(last), few)))
    found = near.unionByName(more).distinct()
    return found.withColumn("_n", place).where(F.col("_n") <= most).select("b", "asked", "held", "overlap", "least")


def candidates(deals: DataFrame, catalogue: DataFrame, most: int = D.MATCH_CANDIDATES) -> DataFrame:
    """Catalogue items for each deal: those with its code, else those of its brand that share words of the core title,
    the ``most`` with the largest overlap.

    Deals: ``deal_id, upc, attrs``; catalogue: ``item, upcs, item_attrs``, where both ids are keys. Deals and items are
    grouped by (brand, set of words), and only distinct sets meet (``largest_overlaps``). An item set hands on its first
    ``most`` items, a deal set meets its best ``most`` item sets, since each of these has an item before those of other
    sets; so no word is too common to count. A deal without a brand meets the items of all brands. Codes and words are
    taken once and dealt over tasks by id, so none sorts more than its share, however the tables are stored.
    """
    words = lambda attrs: F.array_sort(F.filter(F.array_distinct(F.split(F.lower(F.col(attrs)["core_title"]), " ")), lambda w: F.length(w) > 1))
    brand = lambda attrs: F.coalesce(F.lower(F.col(attrs)["brand"]), F.lit("")).alias("b")
    deals = spread(saved(deals.select("deal_id", "upc", brand("attrs"), words("attrs").alias("asked"))), "deal_id")
    catalogue = spread(saved(catalogue.select("item", "upcs", brand("item_attrs"), words("item_attrs").alias("held"))), "item")
    codes = catalogue.select("item", F.explode("upcs").alias("upc"))
    by_code = deals.where(F.col("upc").isNotNull()).join(codes, "upc").select("deal_id", "item", F.lit(True).alias("by_code"), F.lit(99).alias("overlap"))
    rest = deals.join(by_code.select("deal_id").distinct(), "deal_id", "left_anti")
    asked = rest.select("deal_id", "b", "asked").where("size(asked) > 0")
    held = catalogue.select("item", "b", "held").where("size(held) > 0")
    held = held.where("b <> ''").unionByName(held.withColumn("b", F.lit("")))  # deals without a brand meet all items
    # the first items of each set; the window keeps that many in every task before its shuffle
    place = F.row_number().over(W.partitionBy("b", "held").orderBy("item"))
    firsts = held.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
    sets = largest_overlaps(asked, firsts.groupBy("b", "held").agg(F.min("item").alias("least")), most).drop("least")
    place = F.row_number().over(W.partitionBy("b", "asked").orderBy(F.desc("overlap"), "item"))
    best = sets.join(firsts, ["b", "held"]).withColumn("_n", place).where(F.col("_n") <= most).select("b", "asked", "item", "overlap")
    shared = asked.join(best, ["b", "asked"])
    found = by_code.unionByName(shared.select("deal_id", "item", F.lit(False).alias("by_code"), "overlap"))
    rn = F.row_number().over(W.partitionBy("deal_id").orderBy(F.desc("overlap"), "item"))
    return found.withColumn("rn", rn).where(F.col("rn") <= most).drop("rn")


def match(deals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Scores every candidate, keeps the best three of each deal that aren't discarded."""
    deals, catalogue = saved(deals), saved(catalogue)
    pairs = candidates(deals, catalogue).join(deals, "deal_id").join(catalogue, "item")
    brand, pack, size = agreement(F.col("attrs"), F.col("item_attrs"))
    pairs = pairs.withColumn("similarity", rounded(title_similarity(F.col("attrs")["core_title"], F.col("item_attrs")["core_title"]), 4))
    pairs = pairs.withColumn("confidence", confidence(F.col("by_code"), brand, pack, size, F.col("similarity"), price_sane(F.col("price"), F.col("item_price"))))
    pairs = pairs.withColumn("lane", route(F.col("confidence")))
    rn = F.row_number().over(W.partitionBy("deal_id").orderBy(F.desc("confidence"), "item"))
    best = pairs.withColumn("rn", rn).where((F.col("rn") <= D.MATCH_WRITTEN) & (F.col("lane") != "discard"))
    return best.select("deal_id", "item", "by_code", "similarity", "confidence", "lane")


def deal_status(deals: DataFrame, matches: DataFrame) -> DataFrame:
    hit = matches.select("deal_id").distinct().withColumn("_m", F.lit(True))
    return deals.join(hit, "deal_id", "left").withColumn("status", F.when(F.col("_m"), "matched").otherwise("discarded")).drop("_m")


def match_quality(pairs: DataFrame, least: float = D.MATCH_VERIFY, enough: int = 30) -> DataFrame:
    """Precision and recall over labelled pairs (``confidence, expected``); one row."""
    said = F.col("confidence") >= least
    out = pairs.agg(
        F.count_if(said & F.col("expected")).alias("tp"),
        F.count_if(said & ~F.col("expected")).alias("fp"),
        F.count_if(~said & F.col("expected")).alias("fn"),
        F.count_if(~said & ~F.col("expected")).alias("tn"),
    )
    share = lambda a, b: rounded(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 4)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), (n >= enough).alias("trusted"))


def real_cost(price: Column, stack: Column) -> Column:
    """What a deal costs after stacked discounts, of which at most 95 % count."""
    return rounded(price * (1 - F.greatest(F.lit(0.0), F.least(F.coalesce(stack, F.lit(0.0)), F.lit(0.95)))), 2)


def apply_matches(matches: DataFrame, deals: DataFrame, leads: DataFrame) -> DataFrame:
    """What each match does to its lead: approved or sure ones give it a real cost and profit; others say why not."""
    rows = matches.join(deals.select("deal_id", F.col("price").alias("deal_price"), "stack"), "deal_id").join(leads.select("item", "net", "sourced"), "item", "left")
    cost = real_cost(F.col("deal_price"), F.col("stack"))
    status = (
        F.when(F.col("review") == "rejected", "rejected")
        .when(~((F.col("review") == "approved") | (F.col("confidence") >= D.MATCH_AUTO)), "unverified")
        .when(~F.coalesce(F.col("deal_price") > 0, F.lit(False)), "no price")
        .when(F.col("sourced").isNull(), "no lead")
        .when(F.col("sourced"), "already sourced")
        .otherwise("applied")
    )
    rows = rows.withColumn("status", status).withColumn("cost", F.when(F.col("status") == "applied", cost))
    return rows.withColumn("profit", rounded(F.col("net") - F.col("cost"), 2)).withColumn("roi", rounded((F.col("net") - F.col("cost")) / F.col("cost"), 3))


def new_leads(matches: DataFrame, deals: DataFrame, leads: DataFrame, scored: DataFrame) -> DataFrame:
    """Leads that begin with a deal: each matched item that isn't a lead yet, with the cost of its cheapest deal, profit,
    return and status. ``scored``: ``item, score, verdict, hard_reject, net``.

    Sure or approved matches count; an item that a gate rejects, or that has no deal with a price, says so.
    """
    sure = matches.where((F.col("confidence") >= D.MATCH_AUTO) | (F.col("review") == "approved")).select("deal_id", "item")
    fresh = sure.join(leads.select("item"), "item", "left_anti")
    cost = real_cost(F.col("price"), F.col("stack"))
    priced = fresh.join(deals.select("deal_id", F.when(F.col("price") > 0, cost).alias("cost")), "deal_id")
    best = priced.groupBy("item").agg(F.min("cost").alias("cost"), F.min_by("deal_id", F.struct("cost", "deal_id")).alias("deal_id"), F.count("*").alias("deals"))
    out = best.join(scored.select("item", "score", "verdict", "hard_reject", "net"), "item")
    status = F.when(F.col("hard_reject").isNotNull(), "rejected").when(F.col("cost").isNull(), "no price").otherwise("new")
    out = out.withColumn("status", status).withColumn("cost", F.when(F.col("status") == "new", F.col("cost")))
    gain = F.col("net") - F.col("cost")
    return out.select("item", "deal_id", "deals", "score", "verdict", "status", "cost", rounded(gain, 2).alias("profit"), rounded(gain / F.col("cost"), 3).alias("roi"))


def hints(deals: DataFrame, friendly: list[str], avoid: list[str]) -> DataFrame:
    """Strength of each (brand, store): a priced deal counts 1, half more with a good discount. The brand is the deal's
    own if it is friendly, else the first listed one that is a whole word of the title."""
    title, field = F.lower("title"), F.lower(F.coalesce("brand", F.lit("")))
    found = F.lit(None).cast("string")
    for name in friendly[::-1]:
        found = F.when(title.rlike(rf"(?<!\w)\Q{name.lower()}\E(?!\w)"), name.lower()).otherwise(found)
    brand = F.when(field.isin([n.lower() for n in friendly]), field).otherwise(found)
    good = deals.where((F.col("price") > 0) & (F.col("confidence") >= D.HINT_CONFIDENCE)).withColumn("hint", brand)
    good = good.where(F.col("hint").isNotNull() & ~F.col("hint").isin([n.lower() for n in avoid]))
    weight = 1 + F.when(F.col("discount") >= D.HINT_DISCOUNT, 0.5).otherwise(0.0)
    return good.groupBy("hint", "store").agg(F.sum(weight).alias("strength"), F.max("seen").alias("seen"))


def seeds(made: DataFrame, now: Column, least: float = D.HINT_STRENGTH, ttl_days: int = D.HINT_TTL_HOURS // 24) -> DataFrame:
    """Brands of hints that are strong enough and not expired, the strongest first."""
    fresh = made.where((F.datediff(now, "seen") <= ttl_days) & (F.col("strength") >= least))
    return fresh.groupBy(F.lower("hint").alias("brand")).agg(F.max("strength").alias("strength")).orderBy(F.desc("strength"), "brand")


def source_health(events: DataFrame, retire_at: int = 2) -> DataFrame:
    """Each url's state after its events in order (``url, seq, code, fallback``): refusals in a row retire a source
    that has a fallback, a success resets them, and retired is the end. Events are followed in sorted runs, which may
    spill; none are gathered."""
    so_far = W.partitionBy("url").orderBy("seq")
    run = F.count_if(F.col("code") == 200).over(so_far.rowsBetween(W.unboundedPreceding, 0))
    refused = F.count_if(F.col("code") == 403).over(W.partitionBy("url", "_run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumn("_run", run).withColumn("_refused", refused)
    out = rows.groupBy("url").agg(
        F.max_by("_refused", "seq").cast("int").alias("refused"),
        F.max(F.coalesce((F.col("_refused") >= retire_at) & F.col("fallback"), F.lit(False))).alias("_retired"),
    )
    return out.select("url", "refused", F.when(F.col("_retired"), "retired").when(F.col("refused") > 0, "failing").otherwise("ok").alias("state"))


def validate_registry(entries: DataFrame, codes: list[str]) -> DataFrame:
    """Problems of a source list (``rank, domain, code``): missing and repeated ranks, repeated domains, unknown codes."""
    ranks = entries.sparkSession.range(1, entries.count() + 1).select(F.col("id").cast("int").alias("rank"))
    missing = ranks.join(entries, "rank", "left_anti").select(F.lit("missing rank").alias("problem"), F.col("rank").cast("string").alias("value"))
    twice = lambda c, name: entries.groupBy(c).count().where("count > 1").select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("value"))
    unknown = entries.where(~F.col("code").isin(codes)).select(F.lit("unknown code").alias("problem"), F.col("code").alias("value")).distinct()
    return missing.unionByName(twice("rank", "repeated rank")).unionByName(twice("domain", "repeated domain")).unionByName(unknown)
