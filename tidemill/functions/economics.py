"""Unit economics of an item as column expressions: fees, profit, margin, break-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions.rounding import rounded


def known(price: Column) -> Column:
    """The price, null if it is missing or not positive: both mean that there is none."""
    return F.when(price > 0, price)


def fulfilment_fee(weight_lb: Column) -> Column:
    w = F.coalesce(weight_lb, F.lit(1.0))
    fee = None
    for limit, value in D.FULFILMENT_TIERS:
        fee = F.when(w <= limit, value) if fee is None else fee.when(w <= limit, value)
    limit, value = D.FULFILMENT_TIERS[-1]
    return fee.otherwise(value + D.EXTRA_HALF_POUND * (w - limit) / 0.5)


def inbound_shipping(weight_lb: Column) -> Column:
    return rounded(F.coalesce(weight_lb, F.lit(1.0)) * D.INBOUND_PER_LB, 2)


def referral_rate(category: Column, price: Column, rates: dict[str, float] | None = None, banded: dict[str, tuple[float, float, float]] | None = None) -> Column:
    """A category's rate; ``banded`` gives (price limit, rate up to it, rate above it) and goes first."""
    key = F.lower(F.trim(category))
    rate = F.lit((rates or {}).get("default", D.REFERRAL_RATE))
    for name, value in sorted((rates or {}).items()):
        rate = F.when(key == name, value).otherwise(rate)
    for name, (limit, low, high) in sorted((banded or {}).items()):
        rate = F.when(key == name, F.when(price <= limit, low).otherwise(high)).otherwise(rate)
    return rate


def referral_fee(price: Column, category: Column | None = None, **rates) -> Column:
    """The rate's share of the price; the least fee holds only where the category is known."""
    flat = price * D.REFERRAL_RATE
    if category is None:
        return flat
    named = F.greatest(price * referral_rate(category, price, **rates), F.lit(D.MIN_REFERRAL_FEE))
    return F.when(F.coalesce(category, F.lit("")) != "", named).otherwise(flat)


def _after_fees(price: Column, weight_lb: Column, category: Column | None, **rates) -> Column:
    fulfilment = fulfilment_fee(weight_lb) * (1 + D.FUEL_SURCHARGE)
    return price - referral_fee(price, category, **rates) - fulfilment - D.PREP_COST - inbound_shipping(weight_lb)


def net_proceeds(price: Column, weight_lb: Column, category: Column | None = None, **rates) -> Column:
    """What a sale leaves before the cost of the goods."""
    price = known(price)
    return rounded(_after_fees(price, weight_lb, category, **rates), 2)


def landed_cost(price: Column, share: float = D.BUY_COST_SHARE) -> Column:
    """The assumed buying cost."""
    return rounded(known(price) * share, 2)


def profit_roi(price: Column, weight_lb: Column, category: Column | None = None, share: float = D.BUY_COST_SHARE, **rates) -> tuple[Column, Column]:
    """Profit a unit and its ratio to the assumed buying cost."""
    price = known(price)
    cost = price * share
    profit = _after_fees(price, weight_lb, category, **rates) - cost
    return rounded(profit, 2), rounded(F.when(cost > 0, profit / cost), 3)


def profit_roi_real_fees(price: Column, buy_cost: Column, referral: Column, fulfilment: Column, weight_lb: Column) -> tuple[Column, Column]:
    """The same with a real buying cost and quoted fees; null if any of them is missing or the cost isn't positive."""
    cost = F.when(buy_cost > 0, buy_cost)
    profit = known(price) - referral - fulfilment - cost - D.PREP_COST - inbound_shipping(weight_lb)
    return rounded(profit, 2), rounded(profit / cost, 3)


def product_margin(price: Column, weight_lb: Column) -> Column:
    """Net margin of an own product after fees, goods and advertising."""
    price = known(price)
    net = price * (1 - D.REFERRAL_RATE - D.COGS_SHARE - D.ADS_SHARE) - fulfilment_fee(weight_lb) * (1 + D.FUEL_SURCHARGE)
    return net / price


def contribution_margin(price: Column, cost: Column, weight_lb: Column, ads_share: float = D.ADS_SHARE) -> Column:
    """Dollars left of a sale after fees, goods and advertising."""
    price = known(price)
    return rounded(price - price * D.REFERRAL_RATE - fulfilment_fee(weight_lb) - cost - price * ads_share, 2)


def break_even_price(cost: Column, weight_lb: Column) -> Column:
    """The price at which fees and the cost take all."""
    fixed = fulfilment_fee(weight_lb) * (1 + D.FUEL_SURCHARGE) + D.PREP_COST + inbound_shipping(weight_lb)
    return rounded((cost + fixed) / (1 - D.REFERRAL_RATE), 2)


def max_cost(price: Column, weight_lb: Column, min_profit: float = D.MIN_PROFIT, min_roi: float = D.MIN_ROI) -> Column:
    """The most that may be paid so that both the least profit and the least return hold."""
    left = net_proceeds(price, weight_lb)
    return rounded(F.least(left - min_profit, left / (1 + min_roi)), 2)


def consistent_label(profit: Column, cost: Column, category: Column) -> Column:
    """Whether a purchase would have met the profit and return gates; unknown if the cost isn't positive."""
    bar = F.when(F.lower(F.trim(category)) == "grocery", D.GROCERY_MIN_ROI).otherwise(D.MIN_ROI)
    return F.when((cost > 0) & profit.isNotNull(), (profit >= D.MIN_PROFIT) & (profit / cost >= bar))


def cost_free_target(profit: Column, cost: Column, price: Column) -> Column:
    """The largest safe cost as a share of the price, clipped to [-1, 2]."""
    net = profit + cost
    share = F.least(net - D.MIN_PROFIT, net / (1 + D.MIN_ROI)) / known(price)
    return rounded(F.greatest(F.least(share, F.lit(2.0)), F.lit(-1.0)), 4)


def crashed(price_then: Column, price_later: Column, ratio: float = 0.70) -> Column:
    return price_later < ratio * price_then


def swarmed(offers_then: Column, offers_later: Column, ratio: float = 1.5) -> Column:
    return F.when(offers_then > 0, offers_later >= ratio * offers_then)
