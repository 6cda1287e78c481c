"""Walk-forward validation: folds are a key column, so all of them run in one plan."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.operators import align, backtest, factors, ic, regime
from alphaloom.plans import model, panel
from alphaloom.registry import query
from alphaloom.session import scratch_root, staged, written_out
from alphaloom.sources import tables
from alphaloom.sql import FACTORS, FUNDAMENTAL, sql

ALL = FACTORS + FUNDAMENTAL
LEAST_TRAIN_DAYS, LEAST_TEST_DAYS = 30, 10


def folds(spark: SparkSession, start: date, end: date, train_years: int = 2, test_years: int = 1) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end): tests follow each other; one that passes ``end`` is left out."""
    rows, first = [], date(start.year + train_years, start.month, start.day)
    while True:
        last = date.fromordinal(date(first.year + test_years, first.month, first.day).toordinal() - 1)
        if last > end:
            break
        rows.append((len(rows), date(first.year - train_years, first.month, first.day), date.fromordinal(first.toordinal() - 1), first, last))
        first = date(first.year + test_years, first.month, first.day)
    return spark.createDataFrame(rows, "fold int, train_start date, train_end date, test_start date, test_end date")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly folds over the dates of the data, 2 years of training."""
    a, b = tables.read(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return folds(spark, date(a.year, 1, 1), b)


def selection(spark: SparkSession, sf_dir: str, z: DataFrame | None = None, names: list[str] = ALL) -> DataFrame:
    """(fold, factor, weight, ...): the ``names`` of the panel ``z`` chosen on each fold's training interval; forward prices may lie after it."""
    z = align.in_folds(panel.z_panel(spark, sf_dir) if z is None else z, calendar(spark, sf_dir)).filter("sample = 'train'")
    fwd = ic.forward_returns(tables.bars(spark, sf_dir), [21]).select("date", "ticker", F.col("ret_21d").alias("fwd"))
    return ic.select_factors(ic.ic_summary(ic.rank_ic(factors.long_form(z, names, "fold"), fwd, "fold"), "fold"))


def signals(spark: SparkSession, sf_dir: str, *variants: str, panel_: DataFrame | None = None, names: list[str] = ALL) -> DataFrame:
    """(variant, fold, sample, date, ticker, score) with each fold's own weights; folds with too few days or no factor drop out.

    ``variants``: plain (the selected factors' signs) and regime (regime weights of the selected factors). ``panel_``: a table with the
    factors ``names``, else the z-scored panel.
    """
    panel_ = staged(panel.z_panel(spark, sf_dir), "walk-panel") if panel_ is None else panel_
    z = align.in_folds(panel_, calendar(spark, sf_dir))
    days = z.groupBy("fold", "sample").agg(F.count_distinct("date").alias("d"))
    enough = days.groupBy("fold").agg(F.max(F.when(F.col("sample") == "train", F.col("d"))).alias("a"), F.max(F.when(F.col("sample") == "test", F.col("d"))).alias("b"))
    enough = enough.filter((F.col("a") >= LEAST_TRAIN_DAYS) & (F.col("b") >= LEAST_TEST_DAYS)).select("fold")
    chosen = staged(selection(spark, sf_dir, panel_, names).filter("weight <> 0").select("fold", "factor", "weight").join(enough, "fold", "left_semi"), "walk-weights")
    long = factors.long_form(z, names, "fold", "sample")
    out = None
    for variant in variants:
        if variant == "regime":
            keyed = chosen.withColumn("sample", F.explode(F.array(F.lit("train"), F.lit("test"))))
            s = regime.regime_composite(long, regime.bear_scores(tables.index_prices(spark, sf_dir)), keyed, "fold", "sample")
        else:
            j = long.join(F.broadcast(chosen), ["fold", "factor"])  # folds x factors rows
            s = j.groupBy("fold", "sample", "date", "ticker").agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0))).alias("score"))
        s = s.select(F.lit(variant).alias("variant"), "fold", "sample", "date", "ticker", F.round("score", 9).alias("score"))
        out = s if out is None else out.unionAll(s)
    return out


def walk_forward(spark: SparkSession, sf_dir: str, *variants: str, top: int = 5, use_multiplier: bool = True, panel_: DataFrame | None = None, names: list[str] = ALL) -> DataFrame:
    """(variant, fold, sample, date, leg, ret) of every fold's training and test run; variants and folds are keys of one plan.

    Panel, weights, signals and closes are staged: each is computed once, and no plan repeats the trades behind them.
    """
    scale = regime.multiplier(tables.index_prices(spark, sf_dir)) if use_multiplier else None
    prices = staged(tables.bars(spark, sf_dir).select("date", "ticker", "close"), "walk-closes")
    found = staged(signals(spark, sf_dir, *(variants or ("plain",)), panel_=panel_, names=names), "walk-signals")
    return backtest.long_short(found, prices, top, "monthly", scale, "variant", "fold", "sample")


def summary(daily: DataFrame) -> DataFrame:
    """(leg, folds, mean_sharpe, positive, mean_return, worst_drawdown) of the test runs."""
    p = backtest.performance(daily.filter("sample = 'test'"), "fold", "leg")
    return p.groupBy("leg").agg(F.count("*").alias("folds"), F.avg("sharpe").alias("mean_sharpe"), F.avg((F.col("sharpe") > 0).cast("double")).alias("positive"), F.avg("annual_return").alias("mean_return"), F.min("max_drawdown").alias("worst_drawdown"))


def stitched(daily: DataFrame) -> DataFrame:
    """(date, leg, ret, equity ...): test runs end to end; each piece starts where the one before it ended."""
    from pyspark.sql import Window

    d = daily.filter("sample = 'test'")
    first = F.row_number().over(Window.partitionBy("fold", "leg").orderBy("date")) == 1
    return backtest.equity(d.select("leg", "date", F.when(first, 0.0).otherwise(F.col("ret")).alias("ret")), "leg")


def compared(daily: DataFrame, a: str, b: str, close: float = 0.05) -> DataFrame:
    """(fold, a, b, delta, verdict) of the ls legs' test Sharpe ratios of two variants."""
    p = backtest.performance(daily.filter("sample = 'test' AND leg = 'ls'"), "variant", "fold")
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("sharpe")))
    d = p.groupBy("fold").agg(of(a).alias("a"), of(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").withColumn("delta", F.col("b") - F.col("a"))
    return d.withColumn("verdict", F.when(F.col("delta") > close, "better").when(F.col("delta") < -close, "worse").otherwise("same"))


@query("b03_folds", sql("fold train_start train_end test_start test_end", "FROM folds"))
def b03(spark, sf_dir):
    return calendar(spark, sf_dir)


@query("j06_rows_in_folds", sql("fold sample #n", "FROM (SELECT fold, sample, count(*) AS n FROM zs JOIN spans ON date BETWEEN a AND b GROUP BY 1, 2)"))
def j06(spark, sf_dir):
    return align.in_folds(panel.z_panel(spark, sf_dir), calendar(spark, sf_dir)).groupBy("fold", "sample").agg(F.count("*").alias("n"))


@query("r28_fold_selection", sql("fold factor ~t_stat weight", "FROM fsel"))
def r28(spark, sf_dir):
    return selection(spark, sf_dir).select("fold", "factor", "t_stat", "weight")


@query("b08_selection_matrix", sql("fold " + " ".join(ALL), "FROM (SELECT fold, " + ", ".join(f"CAST(coalesce(max(CASE WHEN factor = '{f}' THEN weight END), 0) AS INT) AS {f}" for f in ALL) + " FROM fsel GROUP BY 1)"))
def b08(spark, sf_dir):
    """Fold x factor: 1, -1 or 0."""
    return selection(spark, sf_dir).groupBy("fold").pivot("factor", ALL).agg(F.max("weight")).na.fill(0)


@query("r26_regime_weights", sql("date factor weight", "FROM (SELECT date, factor, CAST(w AS INT) AS weight FROM mult JOIN regw ON bs = bear_score)"))
def r26(spark, sf_dir):
    return regime.bear_scores(tables.index_prices(spark, sf_dir)).join(F.broadcast(regime.regime_weights(spark)), "bear_score").select("date", "factor", "weight")


@query("r27_regime_composite", sql("fold sample date ticker ~score", "FROM (SELECT * FROM fscore WHERE variant = 'regime')"))
def r27(spark, sf_dir):
    return signals(spark, sf_dir, "regime").drop("variant")


@query("b04_walk_forward", sql("fold sample leg #n ~sharpe ^annual_return ^max_drawdown", "FROM (SELECT * FROM fperf WHERE variant = 'plain')"))
def b04(spark, sf_dir):
    return written_out(backtest.performance(walk_forward(spark, sf_dir), "fold", "sample", "leg"), "annual_return", "max_drawdown")


@query("a19_fold_summary", sql("leg #folds ~mean_sharpe ~positive ^mean_return ^worst_drawdown", "FROM (SELECT leg, count(*) AS folds, avg(sharpe) AS mean_sharpe, avg(CAST(sharpe > 0 AS DOUBLE)) AS positive, avg(annual_return) AS mean_return, min(max_drawdown) AS worst_drawdown FROM fperf WHERE variant = 'plain' AND sample = 'test' GROUP BY 1)"))
def a19(spark, sf_dir):
    return written_out(summary(walk_forward(spark, sf_dir)), "mean_return", "worst_drawdown")


@query("u02_stitched_returns", sql("date leg ~ret", "FROM (SELECT date, leg, CASE WHEN row_number() OVER (PARTITION BY fold, leg ORDER BY date) = 1 THEN 0 ELSE ret END AS ret FROM flegs WHERE variant = 'plain' AND sample = 'test')"))
def u02(spark, sf_dir):
    """Test runs end to end; the equity of ``stitched`` compounds these."""
    return stitched(walk_forward(spark, sf_dir)).select("date", "leg", "ret")


@query("b05_regime_comparison", sql("fold ~a ~b ~delta verdict", """FROM (SELECT *, b - a AS delta, CASE WHEN b - a > 0.05 THEN 'better' WHEN b - a < -0.05 THEN 'worse' ELSE 'same' END AS verdict FROM
 (SELECT fold, max(CASE WHEN variant = 'plain' THEN sharpe END) AS a, max(CASE WHEN variant = 'regime' THEN sharpe END) AS b FROM fperf WHERE sample = 'test' AND leg = 'ls' GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL)"""))
def b05(spark, sf_dir):
    return compared(walk_forward(spark, sf_dir, "plain", "regime"), "plain", "regime")


@query("b06_model_signals", sql("fold date ticker ~score", "FROM (SELECT z.fold, z.date, ticker, round(sum(s.weight * coalesce(value, 0)), 9) AS score FROM flong z JOIN fsel s ON s.fold = z.fold AND s.factor = z.factor AND s.weight <> 0 WHERE sample = 'test' GROUP BY 1, 2, 3)"))
def b06(spark, sf_dir):
    """Signals of a model that is fitted on every fold's training rows, saved, loaded and applied to its test rows."""
    z = align.in_folds(staged(panel.z_panel(spark, sf_dir), "model-panel"), calendar(spark, sf_dir))
    fwd = ic.forward_returns(tables.bars(spark, sf_dir), [21]).select("date", "ticker", F.col("ret_21d").alias("fwd"))
    path = f"{scratch_root(spark)}/model-{uuid.uuid4().hex}"
    model.SelectedFactors(ALL, fwd).fit(z.filter("sample = 'train'")).save(path)
    return model.WeightedFactors.load(spark, path, ALL).transform(z.filter("sample = 'test'"))
