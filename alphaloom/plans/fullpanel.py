"""Back-tests and the walk-forward on the full panel: PIN of the yearly fits and both sentiment factors act beside the other factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.operators import backtest, factors
from alphaloom.plans import portfolio, studies, walkforward
from alphaloom.registry import ORACLE_SQL, query
from alphaloom.session import staged, written_out
from alphaloom.sources import tables
from alphaloom.sql import FACTORS, FUNDAMENTAL, on_full_panel

NAMES = [*FACTORS, *FUNDAMENTAL, "pin", "news_sentiment", "filing_sentiment"]


def _sql(name: str) -> str:
    """The SQL of a query on the small panel, on the full one."""
    return on_full_panel(ORACLE_SQL[name], studies.FULL, NAMES, studies.FULL_SCORE)


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full panel as a table: fits and fills are made once, however many branches read it."""
    return staged(studies.full_panel(spark, sf_dir).select("date", "ticker", *NAMES), "full-panel")


def full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_panel(spark, sf_dir).select("date", "ticker", F.round(factors.composite(None, NAMES), 9).alias("score"))


@query("b01_full_long_only", _sql("b01_long_only"))
@tables.read_once
def b01(spark, sf_dir):
    return backtest.long_only(staged(full_scores(spark, sf_dir), "scores"), staged(portfolio.closes(spark, sf_dir), "closes"), 5)


@query("b02_full_long_short", _sql("b02_long_short"))
@tables.read_once
def b02(spark, sf_dir):
    return portfolio.legs(spark, sf_dir, full_scores(spark, sf_dir))


@query("a07_full_leg_metrics", _sql("a07_leg_metrics"))
@tables.read_once
def a07(spark, sf_dir):
    return backtest.performance(b02(spark, sf_dir), "leg")


@query("r28_full_fold_selection", _sql("r28_fold_selection"))
@tables.read_once
def r28(spark, sf_dir):
    return walkforward.selection(spark, sf_dir, full_panel(spark, sf_dir), NAMES).select("fold", "factor", "t_stat", "weight")


@query("b04_full_walk_forward", _sql("b04_walk_forward"))
@tables.read_once
def b04(spark, sf_dir):
    daily = walkforward.walk_forward(spark, sf_dir, panel_=full_panel(spark, sf_dir), names=NAMES)
    return written_out(backtest.performance(daily, "fold", "sample", "leg"), "annual_return", "max_drawdown")


@query("b05_full_regime_comparison", _sql("b05_regime_comparison"))
@tables.read_once
def b05(spark, sf_dir):
    daily = walkforward.walk_forward(spark, sf_dir, "plain", "regime", panel_=full_panel(spark, sf_dir), names=NAMES)
    return walkforward.compared(daily, "plain", "regime")
