"""Registry of the core queries: name -> callable and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import changes, hierarchies, reading, retrieval, stores, structure

MODULES = [hierarchies, retrieval, structure, changes, reading, stores]


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["search"](spark, d)
