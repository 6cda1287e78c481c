"""Point-in-time alignment: as-of joins, bounded fills, date grids, fold intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, facts: DataFrame, by: str, at: str, known: str, values: list[str], skip_null: bool = True) -> DataFrame:
    """``left`` with the last ``values`` known at or before ``left[at]``; missing facts are passed over if ``skip_null``.

    One union and one window on ``by``: no range join, and a fact on the same day counts.
    """
    names = [c for c in left.columns if c not in (by, at)]
    l = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row") if names else F.lit(True).alias("_row"), *(F.lit(None).cast(facts.schema[v].dataType).alias(v) for v in values))  # noqa: E741
    kind = l.schema["_row"].dataType
    r = facts.select(F.col(by).alias("_by"), F.col(known).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"), *values)
    w = Window.partitionBy("_by").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r)
    if skip_null:
        filled = {v: F.last(v, ignorenulls=True).over(w) for v in values}
        both = both.withColumns(filled)
    else:
        last = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
        both = both.withColumn("_last", last).withColumns({v: F.col("_last")[v] for v in values})
    out = both.filter("_side = 1")
    return out.select(F.col("_by").alias(by), F.col("_at").alias(at), *(F.col("_row")[c].alias(c) for c in names), *values)


def asof_forward(events: DataFrame, days: DataFrame, by: str, at: str, out: str) -> DataFrame:
    """``events`` with the first day of ``days`` (by, date) at or after ``at``."""
    e = events.withColumn("_side", F.lit(0)).withColumn("_day", F.lit(None).cast("date"))
    d = days.select(by, F.col("date").alias(at), F.col("date").alias("_day")).withColumn("_side", F.lit(1))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(0, Window.unboundedFollowing)
    both = e.unionByName(d, allowMissingColumns=True).withColumn(out, F.first("_day", ignorenulls=True).over(w))
    return both.filter("_side = 0").drop("_side", "_day")


def bounded_fill(values: DataFrame, days: DataFrame, limit: int, cols: list[str], lag: int = 1) -> DataFrame:
    """Forward fill over the grid (trading days and value dates) x tickers by ``limit`` rows at most, then trading days, lagged."""
    # one row with the calendar, which the days of the data's years bound
    calendar = days.select("date").union(values.select("date")).agg(F.collect_set("date").alias("_days"))
    grid = values.select("ticker").distinct().crossJoin(F.broadcast(calendar)).select(F.explode("_days").alias("date"), "ticker")
    w = Window.partitionBy("ticker").orderBy("date")
    full = grid.join(values, ["date", "ticker"], "left")
    full = full.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in cols})
    full = full.join(days.select("date").distinct(), "date", "left_semi")
    return full.withColumns({c: F.lag(c, lag).over(w) for c in cols}) if lag else full


def business_days(series: DataFrame, values: list[str]) -> DataFrame:
    """A date series on every Monday to Friday of its range; the last row at or before each day counts, nulls as they are."""
    span = series.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")).filter(~F.dayofweek("date").isin(1, 7))
    one = lambda df: df.withColumn("_k", F.lit(0))
    return asof_backward(one(days), one(series), "_k", "date", "date", values, skip_null=False).drop("_k").dropna(subset=values)


def in_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold's training and test interval, keyed by fold and sample; the fold table has tens of rows."""
    spans = folds.select("fold", F.lit("train").alias("sample"), F.col("train_start").alias("_a"), F.col("train_end").alias("_b")).unionAll(folds.select("fold", F.lit("test"), "test_start", "test_end"))
    return panel.join(F.broadcast(spans), F.col("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
