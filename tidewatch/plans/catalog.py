"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the driver tables (whole tables, whole texts) and returns a lazy
DataFrame. Computed columns carry the same alias in Spark and in SQL; doubles are
rounded to 6 places on both sides so float summation order cannot flip a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from tidewatch.plans import q_posts, q_cluster, q_search, q_ingest, q_geo, q_stream  # noqa: F401
