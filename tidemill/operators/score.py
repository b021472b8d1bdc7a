"""Scores candidates by the rules and explains each score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill import defaults as D
from tidemill.functions import economics as E
from tidemill.functions import scoring as S
from tidemill.functions.once import computed_once


def scored(candidates: DataFrame) -> DataFrame:
    """Adds ``profit, roi, base, adjustments, score, hard_reject, verdict, checks``. Map only."""
    profit, roi = E.profit_roi(F.col("price"), F.col("weight_lb"), F.col("category"))
    grocery = F.lower(F.trim(F.coalesce("category", F.lit("")))) == "grocery"
    min_roi = F.when(grocery, D.GROCERY_MIN_ROI).otherwise(D.MIN_ROI)
    out = computed_once(candidates, {"profit": profit, "roi": roi})
    out = computed_once(out, {"base": S.base_score(min_roi), "adjustments": S.adjustments(), "hard_reject": S.hard_reject()})
    out = computed_once(out, {"score": S.adjusted(F.col("base"), F.col("adjustments"))})
    rejected = F.col("hard_reject").isNotNull()
    verdict = F.when(rejected, "pass").when(F.col("score") >= D.SCORE_THRESHOLD, "review").otherwise("pass")
    return out.withColumns({"verdict": verdict, "checks": checks(min_roi)})


def checks(min_roi: Column) -> Column:
    """The six scored checks as an array of (name, passed)."""
    c = D.RESALE
    passed = {
        "bsr": F.coalesce("avg_sales_rank_90", "sales_rank") <= c["rank_max"],
        "sales": F.col("est_sales") >= c["min_sales"],
        "offers": F.col("offers").between(c["min_offers"], c["max_offers"]),
        "roi": F.col("roi") >= min_roi,
        "profit": F.col("profit") >= c["min_profit"],
        "buybox": ~F.col("platform_has_buybox"),
    }
    return F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in passed.items()])
