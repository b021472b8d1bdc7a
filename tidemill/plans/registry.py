"""All registered queries of the library, gathered from the modules of this folder."""

from __future__ import annotations

import importlib

MODULES = (
    "points_in_time",
    "scoring",
    "selection",
    "assembly",
    "evaluation",
    "learning",
    "operations",
    "matching",
    "retrieval",
    "streams",
    "intake",
)


def _gather(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"tidemill.plans.{m}"), what, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
