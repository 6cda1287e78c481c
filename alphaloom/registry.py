"""Where queries register themselves; imports no plan, so any module may be imported first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alphaloom.session import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, exact: bool = False):
    """Register a query, rounded to six digits unless its values are exact, and its SQL."""

    def add(f):
        QUERIES[name] = f if exact else lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
