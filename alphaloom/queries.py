"""The library's own queries, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alphaloom.plans import events, fullpanel, ingestion, panel, portfolio, streams, studies, walkforward  # noqa: F401  (they register their queries)
from alphaloom.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of a monthly top-5 portfolio by composite score over tickers named by part type."""
    return portfolio.flagship(spark, sf_dir)
