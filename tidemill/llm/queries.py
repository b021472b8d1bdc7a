"""The registered queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

import importlib

MODULES = (
    "minhash_dedup",
    "suffix_dedup",
    "toxicity",
    "language_id",
    "quality_rules",
    "quality_classifier",
    "decontamination",
    "byte_bpe",
    "line_dedup",
    "url_filter",
    "personal_data",
    "spelling_variants",
    "phrase_collocations",
)


def _gather(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"tidemill.llm.{m}"), what, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
