"""Named queries: every operator over the given tables, with its SQL where SQL can state it."""

from __future__ import annotations

import importlib

from skygauge.catalog.registry import REGISTRY, Entry

MODULES = ("metric_queries", "source_queries", "series_queries", "feature_queries", "chart_queries", "model_queries")


def load() -> dict[str, Entry]:
    """Import the query modules and return the registry."""
    for name in MODULES:
        importlib.import_module(f"skygauge.catalog.{name}")
    return REGISTRY
