"""Rounding that does not depend on how an engine rounds binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, on the value as a decimal of six places."""
    return F.round(value.cast("decimal(18,6)"), digits).cast("double")


def sql_rounded(value: str, digits: int) -> str:
    """The same in SQL text."""
    return f"CAST(round(CAST({value} AS DECIMAL(18,6)), {digits}) AS DOUBLE)"
