"""Market regimes: bear score, short-leg multiplier, regime weights and the regime-conditional composite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions.expr import change, rolling
from alphaloom.operators.align import business_days

# fixed values: factor weights by bear score
REGIME_WEIGHTS = {
    0: {"momentum_252d": 1, "volatility_20d": 1, "volume_zscore_20d": -1, "amihud_20d": -1, "pb_ratio": 1, "pin": -1, "filing_sentiment": 1},
    1: {"momentum_252d": 1, "volatility_20d": 0, "volume_zscore_20d": -1, "amihud_20d": -1, "pb_ratio": 1, "roe": 1, "pin": -1, "filing_sentiment": 1},
    2: {"momentum_252d": 0, "volatility_20d": -1, "volume_zscore_20d": -1, "amihud_20d": 0, "pb_ratio": -1, "roe": 1, "roa": 1, "pin": -1, "filing_sentiment": 1},
}


def regime_detail(index: DataFrame, vix_threshold: float = 25.0, ma: int = 200, ma_least: int = 100, year: int = 252) -> DataFrame:
    """(date, closes, ma200, mom_12m, the three flags, bear_count); missing comparisons do not count as bearish.

    The index is one series of daily rows, so its window is one partition of a few thousand rows.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    c = F.col("spx_close")
    d = index.withColumns({"ma200": rolling(c, ma, F.avg, w, ma_least), "mom_12m": change(c, w, year)})
    on = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    d = d.withColumns({"vix_high": on(F.col("vix_close") > vix_threshold), "below_ma": on(c < F.col("ma200")), "falling": on(F.col("mom_12m") < 0)})
    return d.withColumn("bear_count", F.col("vix_high") + F.col("below_ma") + F.col("falling"))


def multiplier(index: DataFrame, **options) -> DataFrame:
    """(date, multiplier) on business days: the short leg's size, 0 below two bearish signs, a half at two, 1 at three."""
    d = regime_detail(index, **options)
    d = d.select("date", F.when(F.col("bear_count") >= 3, 1.0).when(F.col("bear_count") == 2, 0.5).otherwise(0.0).alias("multiplier"))
    return business_days(d, ["multiplier"])


def bear_scores(index: DataFrame, **options) -> DataFrame:
    return business_days(regime_detail(index, **options).select("date", "bear_count"), ["bear_count"]).withColumnRenamed("bear_count", "bear_score")


def regime_weights(spark: SparkSession) -> DataFrame:
    """(bear_score 0..3, factor, weight)."""
    rows = [(s, f, w) for s in range(4) for f, w in REGIME_WEIGHTS[min(s, 2)].items()]
    return spark.createDataFrame(rows, "bear_score int, factor string, weight int")


def regime_composite(long: DataFrame, scores: DataFrame, selected: DataFrame, *keys: str) -> DataFrame:
    """(keys, date, ticker, score): regime weights of the selected factors; with none, their own signs.

    ``selected``: (keys, factor, weight) with non-zero weights; dates without a bear score count as 0.
    """
    spark = long.sparkSession
    sel = selected.filter("weight <> 0").select(*keys, "factor", F.col("weight").alias("sign"))
    reg = F.broadcast(regime_weights(spark).filter("weight <> 0"))
    both = sel.join(reg, "factor").select(*keys, "bear_score", "factor", F.col("weight").alias("w"))
    every = F.broadcast(spark.range(4).select(F.col("id").cast("int").alias("bear_score"))).withColumn("_j", F.lit(1))
    have = both.select(*keys, "bear_score").distinct()
    fallback = sel.withColumn("_j", F.lit(1)).join(every, "_j").drop("_j").join(have, [*keys, "bear_score"], "left_anti").select(*keys, "bear_score", "factor", F.col("sign").alias("w"))
    weights = both.unionAll(fallback)  # at most folds x 4 x factors rows
    l = long.join(F.broadcast(scores.select("date", "bear_score")), "date", "left").withColumn("bear_score", F.coalesce("bear_score", F.lit(0)))  # noqa: E741
    j = l.join(F.broadcast(weights), [*keys, "bear_score", "factor"])
    return j.groupBy(*keys, "date", "ticker").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("score"))
