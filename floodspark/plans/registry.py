"""Registry of catalog queries: name -> Spark plan, name -> SQL oracle."""

from __future__ import annotations

import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (and its oracle SQL, when SQL can state it). The registered callable first
    makes sure executors can import the package."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every catalog module so that all queries are registered."""
    from . import catalog, catalog_eval, catalog_device, catalog_sources, catalog_ml  # noqa: F401
