"""Query registry: key → (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and starts from the testdata parquet
tables; every oracle reads the same tables. Builders live next to the
operators they exercise; this module only collects them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from portflow.plans import (  # noqa: F401
        queries_adhoc,
        queries_analytics,
        queries_core,
        queries_quality,
        queries_panel,
        queries_snapshots,
        queries_sources,
    )
