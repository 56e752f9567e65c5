"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle: str | None = None):
    """Register a query builder under ``name`` with its DuckDB oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, oracle)
        return fn

    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # importing the plan modules fills REGISTRY
    from wavepanel.plans import exports, headlines, profiles, reports, sourcing  # noqa: F401

    return REGISTRY
