"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("best_fit_packing", "decontamination", "html_extraction", "jaccard_join", "lm_scoring", "quality_rules", "secret_scans", "simhash", "source_divergence", "substring_dedup", "suffix_dedup", "vector_codes", "warc")


def _all(name: str) -> dict:
    found = [getattr(importlib.import_module(f"tessera.llm.{module}"), name) for module in MODULES]
    return {key: value for one in found for key, value in one.items()}


def queries() -> dict[str, Callable]:
    """Name to function of (spark, folder of tables)."""
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return _all("ORACLES")
