"""Thresholds and tables of the market rules. Fixed values, stated as they are published."""

from __future__ import annotations

# --- point-in-time windows, in days
STEP_DAYS, HORIZON_DAYS, MIN_HISTORY_DAYS = 35, 60, 90
TRACKING_TOLERANCE_DAYS, MEAN_DAYS, DROP_DAYS = 30, 90, 30

# --- label gate
MIN_PROFIT, MIN_ROI, GROCERY_MIN_ROI = 3.0, 0.30, 0.25

# --- criteria for resold items
RESALE = {
    "price_min": 8.0,
    "price_max": 60.0,
    "rank_max": 200000,
    "min_sales": 50,
    "min_offers": 3,
    "max_offers": 25,
    "max_weight": 5.0,
    "min_roi": 0.30,
    "min_profit": 3.0,
}
# --- criteria for own products
PRODUCT = {
    "price_min": 15.0,
    "price_max": 50.0,
    "min_sales": 200,
    "max_reviews": 500,
    "max_rating": 4.3,
    "max_weight": 1.0,
    "max_offers": 15,
}

# --- fees
REFERRAL_RATE, MIN_REFERRAL_FEE, FUEL_SURCHARGE = 0.15, 0.30, 0.035
PREP_COST, INBOUND_PER_LB, BUY_COST_SHARE = 0.50, 0.60, 0.50
COGS_SHARE, ADS_SHARE, TARGET_MARGIN = 0.30, 0.10, 0.25
#: up to so many pounds, the fulfilment fee; above, the last fee plus EXTRA_HALF_POUND for each half pound
FULFILMENT_TIERS = ((0.75, 3.22), (1.0, 4.65), (1.5, 5.50), (2.0, 6.10), (2.5, 6.63), (3.0, 6.75))
EXTRA_HALF_POUND = 0.16

# --- signals
SPIKE_RATIO, CAUTION_RATIO, OFFERS_RISE_RATIO, PLATFORM_SHARE_MAX = 1.5, 1.15, 1.4, 0.20
CLIFF_MIN_AVG, CLIFF_MAX_NOW, WORST_CASE_BAR = 8.0, 2.0, 2.0
PREFERRED_OFFERS, PREFERRED_BONUS, STRESS_FACTOR = (5, 7), 5.0, 0.90

# --- score weights and adjustments
RESALE_WEIGHTS = {"bsr": 20, "sales": 18, "offers": 16, "roi": 22, "profit": 12, "buybox": 12}
PRODUCT_WEIGHTS = {"price": 18, "sales": 18, "reviews": 16, "rating": 12, "weight": 12, "offers": 8, "margin": 16}
ADJUST = {
    "friendly-brand": 5.0,
    "price-spike": -15.0,
    "price-caution": -5.0,
    "offers-rising": -12.0,
    "platform-shares-buybox": -10.0,
    "ip-cliff": -20.0,
    "worst-case-loss": -10.0,
    "no-featured-offer": -8.0,
    "generic-brand": -8.0,
    "price-out-of-band": -8.0,
}
PRICE_BAND_SPAN = 3.0
SCORE_THRESHOLD, TOP_N = 70.0, 5

# --- corpus assembly
BRAND_CAP, CATEGORY_CAP = 0.06, 0.30
CATEGORY_ALARM, BRAND_ALARM = 0.30, 0.25
TIER_WEIGHTS = {"backtest": 1.0, "silver": 2.0, "gold": 4.0}
MIN_TRAINING_ROWS = 30

# --- promotion
PROMOTION_MARGIN, PROMOTION_WINS, RESAMPLES = 0.02, 3, 500

# --- trends, matching, hints, text, inventory
TREND_SPIKE, TREND_STALE_DAYS, WEEK_DAYS = 2.0, 14, 7
MATCH_CANDIDATES, MATCH_WRITTEN, MATCH_AUTO, MATCH_VERIFY, MAX_PRICE_RATIO, CODE_CONFIDENCE = 5, 3, 0.90, 0.60, 3.0, 0.95
HINT_CONFIDENCE, HINT_DISCOUNT, HINT_STRENGTH, HINT_TTL_HOURS = 0.5, 25.0, 2.0, 72
CHUNK_WORDS, CHUNK_OVERLAP, TOKENS_PER_WORD = 600, 75, 1.3
AGED_TIERS, CUT_LOSS_DAYS = (120, 150, 181), 60
