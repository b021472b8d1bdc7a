"""Columns that are computed once however often later expressions name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row ``explode``, so the optimizer doesn't copy long expressions into each use."""
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select("*", F.explode(one).alias("_once")).select(*kept, "_once.*")
