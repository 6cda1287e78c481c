"""Queries that simulate portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from alphaloom.functions.expr import change
from alphaloom.operators import backtest, factors, ranking, regime
from alphaloom.plans import panel
from alphaloom.registry import query
from alphaloom.session import staged
from alphaloom.sources import tables
from alphaloom.sql import sql


def flagship(spark, sf_dir):
    bars = tables.bars(spark, sf_dir, "p_type")
    z = factors.normalise(factors.complete(factors.technical(bars)), factors.TECHNICAL)
    signals = z.select("date", "ticker", factors.composite(None, z.columns).alias("score"))
    return backtest.equity(backtest.long_only(signals, bars, 3).withColumn("leg", F.lit("long")), "leg")


def legs(spark, sf_dir, scores=None):
    scale = regime.multiplier(tables.index_prices(spark, sf_dir))
    return backtest.long_short(staged(panel.scores(spark, sf_dir) if scores is None else scores, "scores"), staged(closes(spark, sf_dir), "closes"), 5, "monthly", scale)


def closes(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("date", "ticker", "close")


@query("b01_long_only", sql("date ~ret", "FROM oleg"))
def b01(spark, sf_dir):
    return backtest.long_only(staged(panel.scores(spark, sf_dir), "scores"), staged(closes(spark, sf_dir), "closes"), 5)


@query("b02_long_short", sql("date leg ~ret", "FROM legs"))
def b02(spark, sf_dir):
    return legs(spark, sf_dir)


@query("w13_index_equity", sql("date ~equity ~drawdown", "FROM ieq"))
def w13(spark, sf_dir):
    from pyspark.sql import Window

    d = tables.index_prices(spark, sf_dir).select("date", F.lit(0).alias("leg"), change(F.col("spx_close"), Window.partitionBy(F.lit(0)).orderBy("date")).alias("ret"))
    return backtest.equity(d, "leg").select("date", "equity", "drawdown")


@query("a07_leg_metrics", sql("leg #n ~sharpe ~annual_return ~max_drawdown", "FROM perf"))
def a07(spark, sf_dir):
    return backtest.performance(legs(spark, sf_dir), "leg")


@query("a03_leg_beta", sql("leg ~beta", "FROM (SELECT leg, CASE WHEN count(*) > 2 THEN covar_samp(l.ret, mkt) / nullif(var_samp(mkt), 0) END AS beta FROM legs l JOIN (SELECT date, avg(ret) AS mkt FROM rets GROUP BY 1) m USING (date) WHERE mkt IS NOT NULL GROUP BY 1)"))
def a03(spark, sf_dir):
    signals, prices = staged(panel.scores(spark, sf_dir), "scores"), staged(closes(spark, sf_dir), "closes")
    daily = backtest.long_short(signals, prices, 5, "monthly", regime.multiplier(tables.index_prices(spark, sf_dir)))
    return backtest.beta(daily, backtest.common_returns(signals, prices), "leg")


@query("w19_rebalance_days", sql("date #valid rebalance", "FROM (SELECT date, valid, reb AS rebalance FROM breb)"))
def w19(spark, sf_dir):
    days = panel.scores(spark, sf_dir).groupBy("date").agg(F.count("score").alias("valid"))
    return backtest.rebalances(days, 5, "monthly").select("date", "valid", "rebalance")


@query("t02_long_and_short_names", sql("date ticker side", "FROM (SELECT date, ticker, 'long' AS side FROM picks WHERE hi <= 5 UNION ALL SELECT date, ticker, 'short' FROM picks WHERE lo <= 5)"))
def t02(spark, sf_dir):
    s = panel.scores(spark, sf_dir)
    s = s.join(w19(spark, sf_dir).filter("rebalance"), "date", "left_semi")
    from pyspark.sql import Window

    down = Window.partitionBy("date").orderBy(F.col("score"), F.col("ticker").desc())
    short = s.withColumn("pos", F.row_number().over(down)).filter("pos <= 5")
    return ranking.top_n(s, 5, "score", "date").select("date", "ticker", F.lit("long").alias("side")).unionAll(short.select("date", "ticker", F.lit("short")))
