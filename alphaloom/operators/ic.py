"""Factor diagnostics: rank IC, its summary, factor selection, mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.expr import by_ticker, correlation, forward_return, mean_rank, ratio
from alphaloom.operators import information


def forward_returns(prices: DataFrame, horizons: list[int]) -> DataFrame:
    """``prices`` (date, ticker, close) with ret_<h>d: the return over the next h rows."""
    w = by_ticker()
    return prices.withColumns({f"ret_{h}d": forward_return(F.col("close"), h, w) for h in horizons})


def rank_ic(long: DataFrame, returns: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """(keys, factor, date, ic, n): Spearman correlation over tickers of factor value and forward return.

    ``long``: (keys, date, ticker, factor, value); ``returns``: (date, ticker, fwd). Fewer than ``least`` pairs give NULL.
    """
    by = [*keys, "factor", "date"]
    pairs = long.join(returns.select("date", "ticker", "fwd"), ["date", "ticker"]).filter(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    ranked = pairs.select(*by, mean_rank(F.col("value"), *by).alias("rv"), mean_rank(F.col("fwd"), *by).alias("rf"))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= least, correlation(F.col("rv"), F.col("rf"))).alias("ic"), F.count("*").alias("n"))


def ic_summary(ic: DataFrame, *keys: str) -> DataFrame:
    """(keys, factor, n, mean_ic, std_ic, icir, positive, t_stat) over the dates with an IC."""
    x = F.col("ic")
    g = ic.groupBy(*keys, "factor").agg(F.count(x).alias("n"), F.avg(x).alias("mean_ic"), F.stddev_samp(x).alias("std_ic"), F.avg(F.when(x.isNotNull(), (x > 1e-12).cast("double"))).alias("positive"))
    return g.withColumns({"icir": ratio(F.col("mean_ic"), F.col("std_ic")), "t_stat": ratio(F.col("mean_ic") * F.sqrt("n"), F.col("std_ic"))})


def select_factors(summary: DataFrame, threshold: float = 2.0) -> DataFrame:
    """``summary`` with weight: the sign of the ICIR where |t| reaches the threshold, else 0."""
    weak = F.col("t_stat").isNull() | (F.abs("t_stat") < threshold)
    return summary.withColumn("weight", F.when(weak, 0).when(F.col("icir") >= 0, 1).otherwise(-1))


# --- mutual information ----------------------------------------------------------------------------------------------


def factor_mi(long: DataFrame, returns: DataFrame, neighbors: int = 5, least: int = 50) -> DataFrame:
    """(factor, mi, n): mutual information of factor and forward return over the pooled panel, in blocks of rows."""
    pairs = long.join(returns.select("date", "ticker", "fwd"), ["date", "ticker"])
    return information.continuous(pairs, ["factor"], "value", "fwd", ["date", "ticker"], neighbors, least)


def combined(summary: DataFrame, mi: DataFrame, nonlinear: float = 1.0) -> DataFrame:
    """IC and MI side by side: ranks of both, their gap, and a flag for non-linear factors."""
    d = summary.join(mi.select("factor", "mi"), "factor", "left")
    has = F.col("mi").isNotNull()
    ranks = {"mi_rank": F.when(has, mean_rank(F.col("mi"), has, descending=True)), "ic_rank": F.when(has, mean_rank(F.abs("mean_ic"), has, descending=True))}
    d = d.withColumn("nonlinearity", F.col("mi") / (F.abs("mean_ic") + 1e-4)).withColumns(ranks).withColumn("rank_gap", F.col("ic_rank") - F.col("mi_rank"))
    flag = has & (((F.col("nonlinearity") >= nonlinear) & (F.abs("icir") < 0.3)) | (F.col("rank_gap") >= 3))
    return d.withColumn("flag", F.coalesce(flag, F.lit(False))).orderBy(F.col("mi").desc_nulls_last())
