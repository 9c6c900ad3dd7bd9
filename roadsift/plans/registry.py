"""Registry of runnable queries: name -> (Spark callable, optional brute-force SQL)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(fn):
        add(name, fn, sql)
        return fn
    return wrap


def load() -> None:
    """Import every query module (each registers its queries when first imported)."""
    import importlib
    for module in ("rules", "tracks", "geometry", "seeds", "delivery", "evaluation", "funnel", "ruled", "sources"):
        importlib.import_module(f"roadsift.plans.{module}_queries")
