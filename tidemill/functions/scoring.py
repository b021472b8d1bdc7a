"""Rule scores, signals, gates and flags of a candidate as column expressions over its facts.

A candidate has the columns ``price, est_sales, offers, weight_lb, sales_rank, avg_sales_rank_90, avg_price_90,
avg_offers_90, platform_share, platform_has_buybox, has_buybox, price_low_90, brand, category, title``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.economics import known, product_margin, profit_roi
from tidemill.functions.rounding import rounded

#: Brands that resell well, and brands that new sellers may not sell.
FRIENDLY_BRANDS = [
    "Jellycat", "Crocs", "Yeti", "Stanley", "Crayola", "Elmer's", "Monster Jam", "LEGO", "Hot Wheels", "Pokemon",
    "Sunny Angels", "Owala", "Gap", "Nautica", "Carter's", "Under Armour", "New Balance", "Hoka", "Mrs. Meyer's",
    "Native", "Milwaukee", "DJI", "Fancy Feast", "Makeup by Mario", "Puma", "Cuddle Duds", "Stafford",
    "Frontier Co-op", "Tonies",
]
AVOID_BRANDS = ["Nike", "Adidas", "Jordan", "Yeezy", "Apple", "Sony", "Disney"]
#: Words that hint at restricted goods, by kind.
RESTRICTED_WORDS = {
    "hazmat/flammable": [
        "battery", "batteries", "lithium", "spray", "aerosol", "flammable", "paint", "bleach", "cleaner", "disinfect",
        "sanitizer", "nail polish", "perfume", "cologne", "fragrance", "magnet", "lighter", "butane", "propane",
    ],
    "prohibited": ["tire", "gift card", "alcohol", "beer", "wine", "vodka", "whiskey"],
    "expiration-dated": [
        "supplement", "vitamin", "protein", "snack", "coffee", "tea", "cereal", "formula", "lotion", "cream", "shampoo",
        "soap", "sunscreen", "cosmetic", "makeup", "serum", " point-after-opening", "pao",
    ],
    "meltable": ["chocolate", "gummy", "gummies", "jelly", "wax", "candle", "lip balm", "crayon"],
}


def band_points(value: Column, low: float, high: float, points: float) -> Column:
    """All points inside the band, fewer in proportion to the distance outside, a quarter if unknown."""
    span = (high - low) or 1
    miss = F.when(value < low, (low - value) / span).otherwise((value - high) / span)
    outside = F.greatest(F.lit(0.0), points * (1 - F.least(miss, F.lit(1.0))))
    return F.when(value.isNull(), points * 0.25).when(value.between(low, high), float(points)).otherwise(outside)


def at_most_points(value: Column, limit: float, points: float, soft: float = 0.5) -> Column:
    over = (value - limit) / (limit or 1)
    beyond = F.greatest(F.lit(0.0), points * (1 - F.least(over * soft, F.lit(1.0))))
    return F.when(value.isNull(), points * 0.25).when(value <= limit, float(points)).otherwise(beyond)


def at_least_points(value: Column, limit: Column | float, points: float) -> Column:
    below = F.greatest(F.lit(0.0), points * (value / limit))
    return F.when(value.isNull(), points * 0.25).when(value >= limit, float(points)).otherwise(below)


def brand_key(brand: Column) -> Column:
    return F.lower(F.trim(F.coalesce(brand, F.lit(""))))


def is_friendly(brand: Column, names: list[str] = FRIENDLY_BRANDS) -> Column:
    """The brand is a listed one or starts with it as words."""
    key = brand_key(brand)
    keys = [n.lower() for n in names]
    return (key != "") & (key.isin(keys) | F.exists(F.array(*map(F.lit, keys)), lambda k: key.startswith(F.concat(k, F.lit(" ")))))


def is_avoided(brand: Column, names: list[str] = AVOID_BRANDS) -> Column:
    """The brand, or one of its words, is a listed one."""
    key = brand_key(brand)
    words = F.split(F.translate(key, "-.", "  "), r"\s+")
    keys = F.array(*[F.lit(n.lower()) for n in names])
    return (key != "") & (F.array_contains(keys, key) | F.arrays_overlap(words, keys))


def restriction_hint(title: Column, brand: Column, words: dict[str, list[str]] = RESTRICTED_WORDS) -> Column:
    """The kinds of restricted goods whose words are in title or brand, joined; null if there are none."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(brand, F.lit(""))))
    hit = [F.when(text.rlike(r"\b(" + "|".join(r"\Q" + w + r"\E" for w in some) + r")\b"), kind) for kind, some in words.items()]
    found = F.array_compact(F.array(*hit))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def compliance_terms(text: Column, terms: list[str]) -> Column:
    """The listed terms that are part of the text."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))


# --- signals


def price_spike(price: Column, average: Column) -> Column:
    return F.coalesce((price > 0) & (average > 0) & (price > average * D.SPIKE_RATIO), F.lit(False))


def price_caution(price: Column, average: Column) -> Column:
    ratio = known(price) / known(average)
    return F.coalesce((ratio >= D.CAUTION_RATIO) & (ratio < D.SPIKE_RATIO), F.lit(False))


def offers_rising(offers: Column, average: Column) -> Column:
    return F.coalesce((offers > 0) & (average > 0) & (offers > average * D.OFFERS_RISE_RATIO), F.lit(False))


def offer_cliff(offers: Column, average: Column) -> Column:
    """A crowd of sellers is gone."""
    return F.coalesce((average >= D.CLIFF_MIN_AVG) & (offers <= D.CLIFF_MAX_NOW), F.lit(False))


def no_featured_offer(has_buybox: Column, offers: Column, buybox_seller_known: Column) -> Column:
    guess = (offers >= 3) & ~F.coalesce(buybox_seller_known, F.lit(False))
    return F.coalesce(~has_buybox, F.lit(False)) | F.coalesce(guess, F.lit(False))


def worst_case_loss(price_low: Column, weight_lb: Column) -> Column:
    """The loss a unit at the lowest price of the last 90 days."""
    profit, _ = profit_roi(price_low, weight_lb)
    return F.when(profit.isNotNull(), rounded(F.greatest(F.lit(0.0), -profit), 2))


# --- scores


def product_score(price: Column, sales: Column, reviews: Column, rating: Column, weight_lb: Column, offers: Column) -> tuple[Column, Column]:
    """The seven-part score of an own product, and its margin."""
    c, w = D.PRODUCT, D.PRODUCT_WEIGHTS
    margin = product_margin(price, weight_lb)
    score = (
        band_points(price, c["price_min"], c["price_max"], w["price"])
        + at_least_points(sales, c["min_sales"], w["sales"])
        + at_most_points(reviews, c["max_reviews"], w["reviews"])
        + at_most_points(rating, c["max_rating"], w["rating"])
        + at_most_points(weight_lb, c["max_weight"], w["weight"])
        + at_most_points(offers, c["max_offers"], w["offers"])
        + at_least_points(margin, D.TARGET_MARGIN, w["margin"])
    )
    return rounded(score, 1), rounded(margin, 4)


def _adjustments() -> list[tuple[str, Column, Column]]:
    """(name, condition, points) in the order in which they apply. Each changes a score that is already rounded."""
    price, offers = F.col("price"), F.col("offers")
    friendly = is_friendly(F.col("brand"))
    spike = price_spike(price, F.col("avg_price_90"))
    low, high = D.RESALE["price_min"], D.RESALE["price_max"]
    span = (high - low) * D.PRICE_BAND_SPAN
    miss = F.when(price < low, low - price).otherwise(price - high) / span
    key = brand_key(F.col("brand"))
    fixed = lambda name: F.lit(D.ADJUST[name])
    return [
        ("friendly-brand", friendly, fixed("friendly-brand")),
        ("avoid-brand", ~friendly & is_avoided(F.col("brand")), F.lit(0.0)),
        ("preferred-offer-band", offers.between(*D.PREFERRED_OFFERS), F.lit(D.PREFERRED_BONUS)),
        ("price-spike", spike, fixed("price-spike")),
        ("price-caution", ~spike & price_caution(price, F.col("avg_price_90")), fixed("price-caution")),
        ("offers-rising", offers_rising(offers, F.col("avg_offers_90")), fixed("offers-rising")),
        ("platform-shares-buybox", (F.col("platform_share") > 0) & ~F.col("platform_has_buybox"), fixed("platform-shares-buybox")),
        ("ip-cliff", offer_cliff(offers, F.col("avg_offers_90")), fixed("ip-cliff")),
        ("worst-case-loss", worst_case_loss(F.col("price_low_90"), F.col("weight_lb")) > D.WORST_CASE_BAR, fixed("worst-case-loss")),
        ("no-featured-offer", no_featured_offer(F.col("has_buybox"), offers, F.col("has_buybox").isNotNull()), fixed("no-featured-offer")),
        ("generic-brand", (key == "") | key.contains("generic"), fixed("generic-brand")),
        ("price-out-of-band", ~price.between(low, high), rounded(D.ADJUST["price-out-of-band"] * F.least(F.lit(1.0), miss), 1)),
    ]


def adjustments() -> Column:
    """The adjustments that apply, in order, as an array of (name, points)."""
    made = [F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(name).alias("name"), points.alias("points"))) for name, on, points in _adjustments()]
    return F.array_compact(F.array(*made))


def base_score(min_roi: Column) -> Column:
    """Six parts over facts and ``profit``, ``roi``."""
    c, w, offers = D.RESALE, D.RESALE_WEIGHTS, F.col("offers")
    rank = F.coalesce("avg_sales_rank_90", "sales_rank")
    by_offers = (
        F.when(offers.isNull(), w["offers"] * 0.25)
        .when(offers < c["min_offers"], w["offers"] * 0.3)
        .when(offers <= c["max_offers"], float(w["offers"]))
        .otherwise(at_most_points(offers, c["max_offers"], w["offers"]))
    )
    return rounded(
        at_most_points(rank, c["rank_max"], w["bsr"], soft=1.0)
        + at_least_points(F.col("est_sales"), c["min_sales"], w["sales"])
        + by_offers
        + at_least_points(F.col("roi"), min_roi, w["roi"])
        + at_least_points(F.col("profit"), c["min_profit"], w["profit"])
        + F.when(F.col("platform_has_buybox"), 0.0).otherwise(float(w["buybox"])),
        1,
    )


def adjusted(base: Column, made: Column) -> Column:
    """Applies signed points one after another: each result is rounded and held within 0 and 100."""

    def step(score: Column, x: Column) -> Column:
        moved = F.round((score + x["points"]).cast("decimal(18,6)"), 1).cast("double")
        return F.when(x["points"] > 0, F.least(F.lit(100.0), moved)).when(x["points"] < 0, F.greatest(F.lit(0.0), moved)).otherwise(moved)

    return F.aggregate(made, base, step)


def hard_reject() -> Column:
    """The first reason that forbids a candidate whatever its score, else null."""
    return (
        F.when(F.col("platform_has_buybox"), "platform holds the buy box")
        .when(F.col("platform_share") >= D.PLATFORM_SHARE_MAX, "platform rotates on the buy box")
        .when(is_avoided(F.col("brand")), "avoided brand")
        .when(offer_cliff(F.col("offers"), F.col("avg_offers_90")), "offers collapsed")
        .when(~F.coalesce(F.col("price") > 0, F.lit(False)), "no price")
    )


def gate_reasons() -> Column:
    """All reasons against a candidate, in order."""
    c = D.RESALE
    return F.array_compact(
        F.array(
            F.when(F.col("platform_has_buybox"), "platform_buybox"),
            F.when(F.col("offers") > c["max_offers"], "too_many_offers"),
            F.when(F.col("weight_lb") > c["max_weight"], "too_heavy"),
            F.when(F.col("roi") < c["min_roi"], "low_roi"),
            F.when(F.col("profit") < c["min_profit"], "low_profit"),
            F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), "no_price"),
        )
    )


def risk_flags() -> Column:
    """Warnings about a candidate, in order."""
    c = D.RESALE
    unknown = F.col("price").isNull() | F.col("sales_rank").isNull() | F.col("est_sales").isNull() | F.col("offers").isNull()
    return F.array_compact(
        F.array(
            F.when(F.col("platform_has_buybox"), "platform_buybox"),
            F.when((F.col("platform_share") > 0) & ~F.col("platform_has_buybox"), "platform_rotates"),
            F.when(restriction_hint(F.col("title"), F.col("brand")).isNotNull(), "restricted"),
            F.when(F.col("offers") < c["min_offers"], "few_sellers"),
            F.when(F.col("offers") > c["max_offers"], "crowded"),
            F.when(~F.col("price").between(c["price_min"], c["price_max"]), "price_band"),
            F.when(F.col("sales_rank") > c["rank_max"], "slow"),
            F.when(F.col("est_sales") < c["min_sales"], "thin_demand"),
            F.when(F.col("roi") < c["min_roi"], "low_roi"),
            F.when(F.col("profit") < c["min_profit"], "low_profit"),
            F.when(F.col("oos_90") > 30, "stockouts"),
            F.when(price_spike(F.col("price"), F.col("avg_price_90")), "price_spike"),
            F.when(offers_rising(F.col("offers"), F.col("avg_offers_90")), "offers_rising"),
            F.when(offer_cliff(F.col("offers"), F.col("avg_offers_90")), "offer_cliff"),
            F.when(worst_case_loss(F.col("price_low_90"), F.col("weight_lb")) > D.WORST_CASE_BAR, "worst_case"),
            F.when(unknown, "incomplete"),
        )
    )


def triage_score(price: Column, weight_lb: Column, sales: Column, category: Column) -> Column:
    """How fast the money comes back at a price that competition has pressed down."""
    stressed = known(price) * D.STRESS_FACTOR
    profit, _ = profit_roi(stressed, weight_lb, category)
    return rounded(profit * sales / (stressed * D.BUY_COST_SHARE), 3)


def blended(rule: Column, probability: Column, weight: float) -> Column:
    """Rule score and model probability; the rule alone if there is no probability."""
    return F.when(probability.isNull(), rule).otherwise(rounded((1 - weight) * rule + weight * 100 * probability, 2))


def velocity(drops: Column, oos_percent: Column, has_buybox: Column) -> Column:
    return rounded(F.coalesce(drops, F.lit(0)) * (1 - F.coalesce(oos_percent, F.lit(0.0)) / 100) + 2 * F.coalesce(has_buybox, F.lit(False)).cast("int"), 3)




def deal_verdict(hard: dict[str, Column], core: dict[str, Column], soft: dict[str, Column]) -> tuple[Column, Column]:
    """PASS if a hard or core check fails, REVIEW if only soft ones do, else BUY; a check that is null is skipped.
    Also the checks as an array of (name, kind, passed)."""
    made = [F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), c.alias("passed")) for kind, some in (("hard", hard), ("core", core), ("soft", soft)) for n, c in some.items()]
    failed = lambda some: F.exists(F.array(*[F.coalesce(~c, F.lit(False)) for c in some.values()]), lambda x: x)
    verdict = F.when(failed(hard | core), "PASS").when(failed(soft), "REVIEW").otherwise("BUY")
    return verdict, F.array(*made)
