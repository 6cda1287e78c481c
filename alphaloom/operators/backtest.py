"""Portfolio simulation as joins and windows: no day loop. ``keys`` (such as a fold) run side by side in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.expr import ratio
from alphaloom.operators.align import asof_backward
from alphaloom.operators.ranking import top_n

YEAR = 252


def common_returns(signals: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """(keys, date, ticker, ret): daily returns over the dates that both sides have; a gap in a ticker gives no return."""
    dates = signals.select(*keys, "date").distinct().join(prices.select("date").distinct(), "date", "left_semi")
    w = Window.partitionBy(*keys).orderBy("date")
    dates = dates.withColumn("_no", F.row_number().over(w))
    p = prices.select("date", "ticker", "close").join(dates, "date")
    t = Window.partitionBy(*keys, "ticker").orderBy("date")
    ret = F.when(F.lag("_no").over(t) == F.col("_no") - 1, ratio(F.col("close"), F.lag("close").over(t)) - 1)
    return p.withColumn("ret", ret).select(*keys, "date", "ticker", "_no", "ret")


def period(kind: str):
    return {"monthly": F.month("date"), "weekly": F.weekofyear("date"), "daily": F.col("date")}[kind]


def rebalances(days: DataFrame, n: int, rebalance: str, *keys: str) -> DataFrame:
    """(keys, date, valid, rebalance): the first day of each period run with ``n`` valid names; a failed day is retried.

    ``days``: (keys, date, valid).
    """
    w = Window.partitionBy(*keys).orderBy("date")
    d = days.withColumn("_p", period(rebalance))
    d = d.withColumn("_new", F.coalesce((F.col("_p") != F.lag("_p").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("valid") >= n, F.col("date"))).over(Window.partitionBy(*keys, "_run"))
    return d.withColumn("rebalance", F.coalesce(F.col("date") == first, F.lit(False))).drop("_p", "_new", "_run")


def _leg(days: DataFrame, picks: DataFrame, returns: DataFrame, at: str, *keys: str) -> DataFrame:
    """(keys, date, ret): mean available return of the names picked on the day ``at`` that is in force; 0 without any."""
    held = days.select(*keys, "date", F.col(at).alias("_at")).join(picks.select(*keys, F.col("date").alias("_at"), "ticker"), [*keys, "_at"])
    r = held.join(returns.select(*keys, "date", "ticker", "ret"), [*keys, "date", "ticker"])
    m = r.groupBy(*keys, "date").agg(F.avg("ret").alias("ret"))
    return days.select(*keys, "date").join(m, [*keys, "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def long_only(signals: DataFrame, prices: DataFrame, top: int = 5, rebalance: str = "monthly", *keys: str) -> DataFrame:
    """(keys, date, ret): equal-weight returns of the top names, chosen on each rebalance day, NULL scores last."""
    returns = common_returns(signals, prices, *keys)
    s = signals.join(returns.select(*keys, "date").distinct(), [*keys, "date"], "left_semi")
    days = rebalances(s.groupBy(*keys, "date").agg(F.count("*").alias("valid")), 1, rebalance, *keys)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_at", F.max(F.when(F.col("rebalance"), F.col("date"))).over(w)).withColumnRenamed("_at", "held_from")
    picks = top_n(s.join(days.filter("rebalance").select(*keys, "date"), [*keys, "date"], "left_semi"), top, "score", *keys, "date")
    return _leg(days, picks, returns, "held_from", *keys)


def long_short(signals: DataFrame, prices: DataFrame, top: int = 5, rebalance: str = "monthly", scale: DataFrame | None = None, *keys: str) -> DataFrame:
    """(keys, date, leg, ret) of the legs long, short and ls.

    With 2n valid scores both legs are chosen, with n to 2n - 1 the longs only and old shorts stay, with fewer nothing
    happens and the next day tries again. ``scale`` (date, multiplier) sizes the short leg, carried forward, 0 before it.
    """
    returns = common_returns(signals, prices, *keys)
    s = signals.filter(F.col("score").isNotNull()).join(returns.select(*keys, "date").distinct(), [*keys, "date"], "left_semi")
    counts = returns.select(*keys, "date").distinct().join(s.groupBy(*keys, "date").agg(F.count("*").alias("valid")), [*keys, "date"], "left")
    days = rebalances(counts.withColumn("valid", F.coalesce("valid", F.lit(0))), top, rebalance, *keys)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("rebalance") & (F.col("valid") >= 2 * top)
    days = days.withColumns({"long_from": F.max(F.when(F.col("rebalance"), F.col("date"))).over(w), "short_from": F.max(F.when(both, F.col("date"))).over(w)})
    chosen = s.join(days.filter("rebalance").select(*keys, "date"), [*keys, "date"], "left_semi")
    # ties at the low end are taken from the end of the same order, so that no name is on both sides
    at = Window.partitionBy(*keys, "date")
    high, low = F.row_number().over(at.orderBy(F.col("score").desc(), "ticker")), F.row_number().over(at.orderBy(F.col("score").asc(), F.col("ticker").desc()))
    sides = F.array(*(F.struct(F.lit(name).alias("side"), (F.col(pos) <= top).alias("in")) for name, pos in (("long", "_high"), ("short", "_low"))))
    picks = chosen.withColumns({"_high": high, "_low": low}).select(*keys, F.col("date").alias("_at"), "ticker", F.explode(F.filter(sides, lambda x: x["in"])).alias("p"))
    picks = picks.select(*keys, "_at", "ticker", F.col("p.side").alias("side"))
    # holdings of both sides at once, one join to the returns, one aggregate for all legs
    force = F.explode(F.array(*(F.struct(F.lit(name).alias("side"), F.col(f"{name}_from").alias("_at")) for name in ("long", "short"))))
    held = days.select(*keys, "date", force.alias("f")).select(*keys, "date", "f.side", "f._at").join(picks, [*keys, "side", "_at"])
    mean = lambda name: F.avg(F.when(F.col("side") == name, F.col("ret"))).alias(f"_{name}")
    both = held.join(returns.select(*keys, "date", "ticker", "ret"), [*keys, "date", "ticker"]).groupBy(*keys, "date").agg(mean("long"), mean("short"))
    d = days.select(*keys, "date").join(both, [*keys, "date"], "left").na.fill(0.0, ["_long", "_short"])
    size = F.lit(1.0)
    if scale is not None:
        d = d.join(F.broadcast(carried(scale, days.select("date"), "multiplier")), "date", "left")  # a row for each date
        size = F.coalesce("multiplier", F.lit(0.0))
    d = d.withColumn("_short", F.lit(0.0) - F.col("_short") * size)
    legs = F.array(*(F.struct(F.lit(name).alias("leg"), value.alias("ret")) for name, value in (("long", F.col("_long")), ("short", F.col("_short")), ("ls", F.col("_long") + F.col("_short")))))
    return d.select(*keys, "date", F.explode(legs).alias("l")).select(*keys, "date", "l.leg", "l.ret")


def carried(series: DataFrame, dates: DataFrame, value: str) -> DataFrame:
    """(date, value) on the distinct ``dates``: the last row of a date series at or before each. One row for each day, whatever
    the number of keys."""
    one = lambda df: df.withColumn("_k", F.lit(0))
    return asof_backward(one(dates.distinct()), one(series.select("date", value)), "_k", "date", "date", [value], skip_null=False).drop("_k")


def equity(daily: DataFrame, *keys: str) -> DataFrame:
    """``daily`` with the compounded equity, its running peak and the drawdown."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)).withColumn("peak", F.max("equity").over(w))
    return d.withColumn("drawdown", ratio(F.col("equity") - F.col("peak"), F.col("peak")))


def performance(daily: DataFrame, *keys: str, skip_zero: bool = True) -> DataFrame:
    """(keys, n, sharpe, annual_return, max_drawdown): Sharpe over the non-zero returns unless told otherwise."""
    e = equity(daily, *keys)
    r = F.when(F.col("ret") != 0, F.col("ret")) if skip_zero else F.col("ret")
    a = e.groupBy(*keys).agg(F.count("*").alias("n"), F.count(r).alias("n_r"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.min_by("equity", "date").alias("e0"), F.max_by("equity", "date").alias("e1"), F.min("drawdown").alias("max_drawdown"))
    sharpe = F.when((F.col("n_r") == 0) | (F.col("sd") == 0), 0.0).otherwise(F.col("m") * YEAR / (F.col("sd") * F.sqrt(F.lit(float(YEAR)))))
    annual = F.when(F.col("n") < 2, 0.0).when(F.col("e1") / F.col("e0") > 0, F.pow(F.col("e1") / F.col("e0"), F.lit(float(YEAR)) / F.col("n")) - 1)
    return a.select(*keys, "n", sharpe.alias("sharpe"), annual.alias("annual_return"), "max_drawdown")


def beta(daily: DataFrame, prices_returns: DataFrame, *keys: str) -> DataFrame:
    """(keys, beta): slope of portfolio returns on the equal-weight market, NULL with two rows or fewer."""
    market = prices_returns.groupBy("date").agg(F.avg("ret").alias("mkt"))
    g = daily.join(market, "date").dropna(subset=["ret", "mkt"]).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_samp("ret", "mkt").alias("c"), F.var_samp("mkt").alias("v"))
    return g.select(*keys, F.when(F.col("n") > 2, ratio(F.col("c"), F.col("v"))).alias("beta"))
