"""Further studies: pairs of labels, baselines, lags, p-values, the full panel, filings by section, the live scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.expr import by_ticker, correlation, forward_return, mean_rank, ratio
from alphaloom.functions.special import chi2_pvalue, normal_cdf, t_pvalue
from alphaloom.operators import factors, ic, information, micro, ranking, stats, text
from alphaloom.plans import events, panel
from alphaloom.registry import ORACLE_SQL, QUERIES, query
from alphaloom.session import staged
from alphaloom.sources import tables
from alphaloom.sql import FACTORS, FUNDAMENTAL, W, corr, live_fit_sql, on_fitted_labels, rank, sql, z

ALL = FACTORS + FUNDAMENTAL
PAIRS = ((1, -1, "good_bad"), (1, 0, "good_none"), (0, -1, "none_bad"))
# fixed values: weights of the live scores
LIVE_WEIGHTS = {"momentum_21d": 1, "momentum_63d": 1, "momentum_252d": 1, "rsi_5d": 1, "price_zscore": 1, "volatility": 1, "amihud": -1, "pb_ratio": 1, "roe": -1, "roa": -1, "pin": -1}

# --- labels side by side ---------------------------------------------------------------------------------------------

_PER = "(SELECT ticker, horizon, " + ", ".join(f"CASE WHEN count(*) FILTER (label = {a}) >= 2 AND count(*) FILTER (label = {b}) >= 2 THEN avg(ret) FILTER (label = {a}) - avg(ret) FILTER (label = {b}) END AS {n}" for a, b, n in PAIRS) + " FROM evl GROUP BY 1, 2)"


def label_pairs(study: DataFrame) -> DataFrame:
    """(ticker, horizon, pair, diff): differences of mean returns between labels, with two days of each at least."""
    of = lambda f, v: f(F.when(F.col("label") == v, F.col("ret")))
    g = study.groupBy("ticker", "horizon").agg(*(of(f, v).alias(f"{n}{v + 1}") for n, f in (("m", F.avg), ("c", F.count)) for v in (-1, 0, 1)))
    diffs = [F.struct(F.lit(n).alias("pair"), F.when((F.col(f"c{a + 1}") >= 2) & (F.col(f"c{b + 1}") >= 2), F.col(f"m{a + 1}") - F.col(f"m{b + 1}")).alias("diff")) for a, b, n in PAIRS]
    return g.select("ticker", "horizon", F.explode(F.array(*diffs)).alias("d")).select("ticker", "horizon", "d.pair", "d.diff")


@query("a14_label_pairs", sql("pair horizon #n ~mean_ ~t_stat ~cohen_dz", f"FROM (SELECT pair, horizon, count(*) AS n, avg(diff) AS mean_, avg(diff) * sqrt(count(*)) / nullif(stddev_samp(diff), 0) AS t_stat, avg(diff) / nullif(stddev_samp(diff), 0) AS cohen_dz FROM (SELECT * FROM {_PER} UNPIVOT (diff FOR pair IN ({', '.join(n for *_, n in PAIRS)}))) GROUP BY 1, 2)"))
def a14(spark, sf_dir):
    return stats.paired(label_pairs(events.study(spark, sf_dir)), "diff", "pair", "horizon").select("pair", "horizon", "n", "mean_", "t_stat", "cohen_dz")


_BEST = "FROM (SELECT pair, arg_max(horizon, abs(m)) AS horizon, arg_max(m, abs(m)) AS diff FROM (SELECT pair, horizon, avg(diff) AS m FROM (SELECT * FROM " + _PER + f" UNPIVOT (diff FOR pair IN ({', '.join(n for *_, n in PAIRS)}))) GROUP BY 1, 2) GROUP BY 1)"


@query("t05_best_horizon", sql("pair horizon ~diff", _BEST))
def t05(spark, sf_dir):
    """The horizon at which two labels differ most."""
    return best_horizon(events.study(spark, sf_dir))


def best_horizon(study: DataFrame) -> DataFrame:
    """(pair, horizon, diff): the greatest mean difference; a pair that no ticker can compare has no row."""
    g = label_pairs(study).filter("diff IS NOT NULL").groupBy("pair", "horizon").agg(F.avg("diff").alias("m"))
    return g.groupBy("pair").agg(F.max_by("horizon", F.abs("m")).alias("horizon"), F.max_by("m", F.abs("m")).alias("diff"))


_IDXR = "(SELECT date, " + ", ".join(f"lead(spx_close, {h}) OVER (ORDER BY date) / nullif(spx_close, 0) - 1 AS r{h}" for h in events.HORIZONS) + " FROM idx)"
_A24 = "SELECT CAST(label AS VARCHAR) AS group_, horizon, ret FROM evl UNION ALL SELECT 'index', CAST(substr(h, 2) AS INT), ret FROM " + _IDXR + " UNPIVOT (ret FOR h IN (" + ", ".join(f"r{h}" for h in events.HORIZONS) + "))"


@query("a24_label_horizon_table", sql("group_ " + " ".join(f"~mean_{h} ~sharpe_{h}" for h in events.HORIZONS), "FROM (SELECT group_, " + ", ".join(f"avg(ret) FILTER (horizon = {h}) AS mean_{h}, avg(ret) FILTER (horizon = {h}) * sqrt(252.0 / {h}) / nullif(stddev_samp(ret) FILTER (horizon = {h}), 0) AS sharpe_{h}" for h in events.HORIZONS) + f" FROM ({_A24}) GROUP BY 1)"))
def a24(spark, sf_dir):
    """Mean return and gross Sharpe ratio of each label and of the index, a column for each horizon."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one series of daily rows
    index = tables.index_prices(spark, sf_dir).select(*(forward_return(F.col("spx_close"), h, w).alias(str(h)) for h in events.HORIZONS))
    index = index.unpivot([], [str(h) for h in events.HORIZONS], "horizon", "ret").select(F.lit("index").alias("group_"), F.col("horizon").cast("int").alias("horizon"), "ret").filter("ret IS NOT NULL")
    both = events.study(spark, sf_dir).select(F.col("label").cast("string").alias("group_"), "horizon", "ret").unionAll(index)
    at = lambda f, h: f(F.when(F.col("horizon") == h, F.col("ret")))
    g = both.groupBy("group_").agg(*(x for h in events.HORIZONS for x in (at(F.avg, h).alias(f"mean_{h}"), at(F.stddev_samp, h).alias(f"sd_{h}"))))
    return g.select("group_", *(x for h in events.HORIZONS for x in (F.col(f"mean_{h}"), ratio(F.col(f"mean_{h}") * (252.0 / h) ** 0.5, F.col(f"sd_{h}")).alias(f"sharpe_{h}"))))


# --- baselines -------------------------------------------------------------------------------------------------------


@query("r30_random_baseline", sql("#n ~mean_ ~annual ~vol ~sharpe", """FROM (SELECT count(*) AS n, avg(ret) AS mean_, avg(ret) * 252 / 20 AS annual, stddev_samp(ret) * sqrt(252.0 / 20) AS vol, avg(ret) * 252 / 20 / nullif(stddev_samp(ret) * sqrt(252.0 / 20), 0) AS sharpe
 FROM (SELECT ret FROM (SELECT ticker, date, ret_20d AS ret FROM ev0 ORDER BY md5('11|' || ticker || '|' || CAST(date AS VARCHAR)), ticker, date LIMIT 5000) WHERE ret IS NOT NULL))"""))
def r30(spark, sf_dir):
    """20-day returns of 5,000 days drawn at random, whatever their label."""
    d = events.labelled(spark, sf_dir).select("date", "ticker", forward_return(F.col("close"), 20, by_ticker()).alias("ret"))
    return risk_adjusted(ranking.seeded_sample(d, 5000, 11, "ticker", "date").filter("ret IS NOT NULL"), 20)


def risk_adjusted(d: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, n, mean_, annual, vol, sharpe) of k-day returns."""
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("mean_"), F.stddev_samp("ret").alias("sd"))
    g = g.select(*keys, "n", "mean_", (F.col("mean_") * 252 / k).alias("annual"), (F.col("sd") * (252.0 / k) ** 0.5).alias("vol"))
    return g.withColumn("sharpe", ratio(F.col("annual"), F.col("vol")))


_IR = "(SELECT date, lead(spx_close, 20) OVER (ORDER BY date) / nullif(spx_close, 0) - 1 AS ret FROM idx)"


@query("r30_index_base_rate", sql("event #n ~mean_ ~annual ~vol ~sharpe", f"""FROM (SELECT event, count(*) AS n, avg(ret) AS mean_, avg(ret) * 252 / 20 AS annual, stddev_samp(ret) * sqrt(252.0 / 20) AS vol, avg(ret) * 252 / 20 / nullif(stddev_samp(ret) * sqrt(252.0 / 20), 0) AS sharpe
 FROM (SELECT coalesce(bad, 0) >= 3 AS event, ret FROM {_IR} LEFT JOIN (SELECT date, count(*) FILTER (label = -1) AS bad FROM lab GROUP BY 1) USING (date) WHERE ret IS NOT NULL) GROUP BY 1)"""))
def r30_base(spark, sf_dir):
    """20-day index returns after days with bad news on three tickers at least, and after all others."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    index = tables.index_prices(spark, sf_dir).select("date", forward_return(F.col("spx_close"), 20, w).alias("ret")).filter("ret IS NOT NULL")
    bad = events.labelled(spark, sf_dir).groupBy("date").agg(F.count(F.when(F.col("label") == -1, 1)).alias("bad"))
    return risk_adjusted(index.join(bad, "date", "left").withColumn("event", F.coalesce(F.col("bad") >= 3, F.lit(False))), 20, "event")


# --- monthly studies -------------------------------------------------------------------------------------------------

_MIC = f"(SELECT ym, count(*) AS n, {corr('rx', 'ry')} AS ic FROM (SELECT ym, {rank('flow_', 'ym')} AS rx, {rank('nxt', 'ym')} AS ry FROM {panel._QT}) GROUP BY 1 HAVING count(*) >= 5)"


@query("a18_monthly_ic", sql("#n_months #n_obs ~mean_ic ~std_ic ~icir ~t_stat ~positive", f"FROM (SELECT count(ic) AS n_months, sum(n) AS n_obs, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0) AS t_stat, avg(CAST(ic > 1e-12 AS DOUBLE)) AS positive FROM {_MIC} WHERE ic IS NOT NULL)"))
def a18(spark, sf_dir):
    """Rank correlations of each month's share of buys with the next month's return, summed up; months of five tickers at least."""
    d = panel.w17(spark, sf_dir)
    r = d.select("ym", mean_rank(F.col("flow_"), "ym").alias("rx"), mean_rank(F.col("nxt"), "ym").alias("ry"))
    m = r.groupBy("ym").agg(F.count("*").alias("n"), correlation(F.col("rx"), F.col("ry")).alias("ic")).filter("n >= 5 AND ic IS NOT NULL")
    g = m.agg(F.count("ic").alias("n_months"), F.sum("n").alias("n_obs"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive"))
    return g.withColumns({"icir": ratio(F.col("mean_ic"), F.col("std_ic")), "t_stat": ratio(F.col("mean_ic") * F.sqrt("n_months"), F.col("std_ic"))})


@query("a17_quintile_spread", sql("~q1 ~q5 ~spread", f"FROM (SELECT q1, q5, q1 - q5 AS spread FROM (SELECT avg(nxt) FILTER (bucket = 1) * 100 AS q1, avg(nxt) FILTER (bucket = 5) * 100 AS q5 FROM {panel._QT}))"))
def a17_spread(spark, sf_dir):
    of = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("nxt"))) * 100
    return panel.w17(spark, sf_dir).agg(of(1).alias("q1"), of(5).alias("q5")).withColumn("spread", F.col("q1") - F.col("q5"))


@query("p07_market_months", sql("ym ~ret regime", "FROM (SELECT ym, ret, CASE WHEN ret > 0.02 THEN 'Bull' WHEN ret < -0.02 THEN 'Bear' ELSE 'Neutral' END AS regime FROM (SELECT ym, c / nullif(lag(c) OVER (ORDER BY ym), 0) - 1 AS ret FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS ym, arg_max(spx_close, date) AS c FROM idx GROUP BY 1)) WHERE ret IS NOT NULL)"))
def p07(spark, sf_dir):
    """Months of the index by its return: above 2 % bull, below -2 % bear."""
    m = tables.index_prices(spark, sf_dir).groupBy(F.trunc("date", "MM").alias("ym")).agg(F.max_by("spx_close", "date").alias("c"))
    m = m.select("ym", (ratio(F.col("c"), F.lag("c").over(Window.partitionBy(F.lit(0)).orderBy("ym"))) - 1).alias("ret")).filter("ret IS NOT NULL")
    return m.withColumn("regime", F.when(F.col("ret") > 0.02, "Bull").when(F.col("ret") < -0.02, "Bear").otherwise("Neutral"))


@query("r29_weight_notes", sql("factor note", "FROM (SELECT factor, CASE WHEN t_stat IS NULL OR abs(t_stat) < 2 THEN '0: not significant' WHEN icir > 0 THEN '1' ELSE '-1: reversal' END AS note FROM icsum)"))
def r29(spark, sf_dir):
    s = ic.ic_summary(panel.information(spark, sf_dir))
    return s.select("factor", F.when(F.col("t_stat").isNull() | (F.abs("t_stat") < 2), "0: not significant").when(F.col("icir") > 0, "1").otherwise("-1: reversal").alias("note"))


@query("t03_largest_scores", sql("date ticker ~score", "FROM (SELECT * FROM score ORDER BY score DESC NULLS LAST, date, ticker LIMIT 5)"))
def t03(spark, sf_dir):
    return panel.scores(spark, sf_dir).orderBy(F.col("score").desc_nulls_last(), "date", "ticker").limit(5)


@query("t04_factors_by_strength", sql("factor ~t_stat pos", "FROM (SELECT factor, t_stat, CAST(row_number() OVER (ORDER BY abs(t_stat) DESC NULLS LAST, factor) AS INT) AS pos FROM icsum)"))
def t04(spark, sf_dir):
    s = ic.ic_summary(panel.information(spark, sf_dir))  # a row for each factor
    return s.select("factor", "t_stat", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs("t_stat").desc_nulls_last(), "factor")).alias("pos"))


# --- labels against returns and sentiment ----------------------------------------------------------------------------

_LR = f"(SELECT date, ticker, label, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM lab)"
_LAGS = f"(SELECT d.date, t.ticker, label, ret FROM (SELECT DISTINCT date FROM lab) d CROSS JOIN (SELECT DISTINCT ticker FROM lab) t LEFT JOIN {_LR} r ON r.date = d.date AND r.ticker = t.ticker)"
_LAGP = "(" + " UNION ALL ".join(f"SELECT {k} AS lag_, ret, {'lead' if k >= 0 else 'lag'}(label, {abs(k)}) OVER {W} AS lbl FROM {_LAGS}" for k in range(-5, 6)) + ")"


@query("r06_lag_correlation", sql("lag_ #n ~spearman ~pearson", f"FROM (SELECT lag_, count(*) AS n, CASE WHEN count(*) >= 50 THEN {corr('rx', 'ry')} END AS spearman, CASE WHEN count(*) >= 50 THEN {corr('lbl', 'ret')} END AS pearson FROM (SELECT *, {rank('lbl', 'lag_')} AS rx, {rank('ret', 'lag_')} AS ry FROM {_LAGP} WHERE ret IS NOT NULL AND lbl IS NOT NULL) GROUP BY 1)"))
def r06(spark, sf_dir):
    """Correlations of daily returns with labels -5 .. 5 dates later on the common date grid."""
    d = events.labelled(spark, sf_dir).select("date", "ticker", "label", (ratio(F.col("close"), F.lag("close").over(by_ticker())) - 1).alias("ret"))
    pairs = events.lag_pairs(d).select(F.col("lag").cast("int").alias("lag_"), "ret", "label")
    enough = lambda c: F.when(F.col("n") >= 50, F.col(c)).alias(c)
    return stats.spearman(pairs, "label", "ret", "lag_").select("lag_", "n", enough("spearman"), enough("pearson"))


def label_sentiment(spark, sf_dir) -> DataFrame:
    """(date, ticker, label, ret): labels and the day's sentiment, where there is one."""
    s = factors.sentiment_daily(tables.sentiment(spark, sf_dir)).groupBy("date", "ticker").agg(F.avg("compound").alias("ret"))
    return events.labelled(spark, sf_dir).select("date", "ticker", "label").join(s, ["date", "ticker"], "left")


@query("j02_label_sentiment", sql("date ticker label ~compound", "FROM (SELECT l.date, l.ticker, label, compound FROM lab l JOIN (SELECT date, ticker, avg(c) AS compound FROM (SELECT ticker, date, doc_type, avg(compound) AS c FROM sen GROUP BY 1, 2, 3) GROUP BY 1, 2) s ON l.date = s.date AND l.ticker = s.ticker WHERE compound IS NOT NULL)"))
def j02(spark, sf_dir):
    return label_sentiment(spark, sf_dir).filter("ret IS NOT NULL").withColumnRenamed("ret", "compound")


@query("r06_label_sentiment_lags")
def r06_sentiment(spark, sf_dir):
    """Lag table of sentiment against labels, with mutual information and its ratio to the linear correlation."""
    d = events.lag_profile(label_sentiment(spark, sf_dir).withColumn("label", F.col("label").cast("double")))
    return d.withColumn("nonlinearity", nonlinearity(F.col("mi"), F.col("pearson")))


def nonlinearity(mi, pearson):
    return mi / F.greatest(F.abs(pearson), F.lit(1e-6))


def permutation_test(pairs: DataFrame, rounds: int = 1000, least: int = 10, ids: tuple = ()) -> DataFrame:
    """(n, mi, shuffled_mean, shuffled_95, p, percentile): mutual information of ret and label against ``rounds`` shuffles of the labels.

    Tasks evaluate their rows of every round, so the shuffle does not grow with the rounds. ``ids``: columns that name a row.
    """
    each = information.discrete(pairs, [], "ret", "label", list(ids), rounds=rounds, least=least)
    real = F.max(F.when(F.col("round") == 0, F.col("mi"))).over(Window.partitionBy(F.lit(0)))  # rounds + 1 rows
    other = F.when(F.col("round") > 0, F.col("mi"))
    g = each.withColumn("real", real).agg(F.max("n").alias("n"), F.max("real").alias("mi"), F.avg(other).alias("shuffled_mean"), F.percentile(other, F.lit(0.95)).alias("shuffled_95"), F.avg((other >= F.col("real")).cast("double")).alias("p"))
    return g.withColumn("percentile", 100 * (1 - F.col("p")))


@query("r05_permutation_test")
def r05(spark, sf_dir):
    return permutation_test(label_sentiment(spark, sf_dir), ids=("date", "ticker"))


@query("r_p_values")
def p_values(spark, sf_dir):
    """(test, statistic, p, effect, stars) of the label studies at five days."""
    s = events.study(spark, sf_dir).filter("horizon = 5")
    welch = stats.welch(s, "ret", "label", 1, -1).select(F.lit("welch").alias("test"), F.col("t_stat").alias("statistic"), t_pvalue("t_stat", "dof").alias("p"), F.col("cohen_d").alias("effect"))
    one = stats.paired(label_pairs(s).filter("pair = 'good_bad'"), "diff").select(F.lit("paired"), "t_stat", t_pvalue("t_stat", (F.col("n") - 1).cast("double")), "cohen_dz")
    kw = stats.kruskal(s, "ret", "label").withColumnRenamed("k", "groups").select(F.lit("kruskal"), "h", chi2_pvalue("h", (F.col("groups") - 1).cast("double")), "eta2")
    mw = stats.mann_whitney(s, "ret", "label", 1, -1).filter("na > 0 AND nb > 0").select(F.lit("mann_whitney"), "u", (2 * (1 - normal_cdf(F.abs("z")))), (F.abs("z") / F.sqrt(F.col("na") + F.col("nb"))))
    sp = stats.spearman(s, "label", "ret").select(F.lit("spearman"), "spearman", t_pvalue(ratio(F.col("spearman") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("spearman") * F.col("spearman"))), (F.col("n") - 2).cast("double")), F.col("spearman"))
    t = lambda r: ratio(r * F.sqrt(F.col("n") - 2), F.sqrt(1 - r * r))
    line = stats.line_fit(s.withColumn("label", F.col("label").cast("double")), "label", "ret").select(F.lit("line_fit"), "slope", t_pvalue(t(F.col("r")), (F.col("n") - 2).cast("double")), F.col("r"))
    return welch.unionAll(one).unionAll(kw).unionAll(mw).unionAll(sp).unionAll(line).withColumn("stars", stars(F.col("p")))


def stars(p):
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


@query("r07_kruskal_p", sql("~h ~p", "FROM (SELECT h, exp(-h / 2) AS p FROM (" + events.KRUSKAL + "))"))
def r07_p(spark, sf_dir):
    """Three labels leave two degrees of freedom, where the chi-square tail is exp(-h / 2)."""
    return stats.kruskal(events.study(spark, sf_dir).filter("horizon = 5"), "ret", "label").select("h", F.exp(-F.col("h") / 2).alias("p"))


# --- the full panel --------------------------------------------------------------------------------------------------


def full_panel(spark, sf_dir, period: str = "annual") -> DataFrame:
    """z-scored factors, with both sentiment factors (z-scored per date) and, raw, PIN and the event label of fitted models."""
    z_ = panel.z_panel(spark, sf_dir).select("date", "ticker", "close", *ALL)
    flow = factors.buy_sell_volume(tables.bars(spark, sf_dir))
    pin = micro.ekop_factor(flow, period).select("date", "ticker", "pin", "event_label")
    return sentiment_panel(spark, sf_dir, z_).join(pin, ["date", "ticker"], "left")


def sentiment_panel(spark, sf_dir, z_: DataFrame) -> DataFrame:
    s = factors.sentiment_factors(tables.sentiment(spark, sf_dir).filter("compound IS NOT NULL"), tables.bars(spark, sf_dir))
    return factors.normalise(z_.join(s, ["date", "ticker"], "left"), ["news_sentiment", "filing_sentiment"])


def _fill(kind: str, limit: int) -> str:
    day = f"(SELECT ticker, date, avg(c) AS v FROM (SELECT ticker, date, doc_type, avg(compound) AS c FROM sen WHERE compound IS NOT NULL GROUP BY 1, 2, 3) WHERE doc_type {kind} GROUP BY 1, 2)"
    grid = f"(SELECT d.date, t.ticker, v FROM (SELECT date FROM ohlcv UNION SELECT date FROM {day}) d CROSS JOIN (SELECT DISTINCT ticker FROM {day}) t LEFT JOIN {day} USING (date, ticker))"
    full = f"(SELECT date, ticker, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW) AS f FROM {grid})"
    return f"(SELECT date, ticker, lag(f) OVER {W} AS v FROM (SELECT * FROM {full} WHERE date IN (SELECT date FROM ohlcv)))"


_SENT = f"(SELECT zs.*, n.v AS news, g.v AS filing FROM zs LEFT JOIN {_fill(chr(61) + ' ' + chr(39) + 'news' + chr(39), factors.NEWS_FILL)} n USING (date, ticker) LEFT JOIN {_fill('<> ' + chr(39) + 'news' + chr(39), factors.FILING_FILL)} g USING (date, ticker))"
_SENTZ = f"(SELECT * EXCLUDE (news, filing), {z('news', 'date')} AS news_sentiment, {z('filing', 'date')} AS filing_sentiment FROM {_SENT})"


@query("j01_sentiment_panel", sql("date ticker ~news_sentiment ~filing_sentiment ~momentum_252d", f"FROM {_SENTZ}"))
def j01_sentiment(spark, sf_dir):
    return sentiment_panel(spark, sf_dir, panel.z_panel(spark, sf_dir).select("date", "ticker", "momentum_252d"))


@query("a20_sentiment_composite", sql("date ticker ~score", f"FROM (SELECT date, ticker, coalesce(momentum_252d, 0) + coalesce(volatility_20d, 0) - coalesce(volume_zscore_20d, 0) - coalesce(amihud_20d, 0) + coalesce(pb_ratio, 0) + coalesce(news_sentiment, 0) + coalesce(filing_sentiment, 0) AS score FROM {_SENTZ})"))
def a20_sentiment(spark, sf_dir):
    d = sentiment_panel(spark, sf_dir, panel.z_panel(spark, sf_dir))
    return d.select("date", "ticker", factors.composite(None, [*ALL, "news_sentiment", "filing_sentiment"]).alias("score"))


FULL = f"SELECT z.*, e.pin, e.event_label FROM {_SENTZ} z LEFT JOIN (SELECT * FROM ekop WHERE period = 'annual') e USING (date, ticker)"
_FULL = f"({FULL})"
FULL_SCORE = "coalesce(momentum_252d, 0) + coalesce(volatility_20d, 0) - coalesce(volume_zscore_20d, 0) - coalesce(amihud_20d, 0) + coalesce(pb_ratio, 0) - coalesce(pin, 0) + coalesce(news_sentiment, 0) + coalesce(filing_sentiment, 0)"
_FULL_NAMES = [*FACTORS, *FUNDAMENTAL, "pin", "event_label", "news_sentiment", "filing_sentiment"]
_FULL_LONG = "(" + " UNION ALL ".join(f"SELECT date, ticker, '{f}' AS factor, CAST({f} AS DOUBLE) AS value FROM fullp" for f in _FULL_NAMES) + ")"
_FULL_SUM = f"""(WITH fullp AS MATERIALIZED (SELECT * FROM {_FULL}), rk AS (SELECT factor, date, {rank('value', 'factor, date')} AS rv, {rank('fwd', 'factor, date')} AS rf FROM {_FULL_LONG} JOIN fwd USING (date, ticker) WHERE value IS NOT NULL AND fwd IS NOT NULL),
 one AS (SELECT factor, date, CASE WHEN count(*) >= 3 THEN {corr('rv', 'rf')} END AS ic FROM rk GROUP BY 1, 2)
 SELECT factor, count(ic) AS n, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 1e-12 AS DOUBLE) END) AS positive, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(ic) * sqrt(count(ic)) / nullif(stddev_samp(ic), 0) AS t_stat FROM one GROUP BY 1)"""


@query("j01_full_panel", sql("date ticker " + " ".join(f"~{f}" for f in [*FACTORS, *FUNDAMENTAL, "pin"]) + " event_label ~news_sentiment ~filing_sentiment", f"FROM {_FULL}"))
def j01(spark, sf_dir):
    return full_panel(spark, sf_dir).select("date", "ticker", *ALL, "pin", "event_label", "news_sentiment", "filing_sentiment")


@query("a20_full_composite", sql("date ticker ~score", f"FROM (SELECT date, ticker, {FULL_SCORE} AS score FROM {_FULL})"))
def a20_full(spark, sf_dir):
    d = full_panel(spark, sf_dir)
    return d.select("date", "ticker", factors.composite(None, [*ALL, "pin", "news_sentiment", "filing_sentiment"]).alias("score"))


@query("a08_full_ic_summary", sql("factor n ~mean_ic ~std_ic ~positive ~icir ~t_stat", f"FROM {_FULL_SUM}"))
def a08_full(spark, sf_dir):
    """IC summary of all factors, PIN, the event label and sentiment included."""
    fwd = ic.forward_returns(tables.bars(spark, sf_dir), [21]).select("date", "ticker", F.col("ret_21d").alias("fwd"))
    names = [*ALL, "pin", "event_label", "news_sentiment", "filing_sentiment"]
    d = full_panel(spark, sf_dir).withColumn("event_label", F.col("event_label").cast("double"))
    return ic.ic_summary(ic.rank_ic(factors.long_form(d, names), fwd))


@query("r21_vdj_factor")
def r21(spark, sf_dir):
    """PIN and day labels of the second model for each ticker and year of order lines."""
    return micro.vdj_factor(tables.line_counts(spark, sf_dir).withColumnRenamed("symbol", "ticker"), "annual")


@query("r22_vdj_symbols")
def r22(spark, sf_dir):
    """The second model on the whole history of every symbol's trade counts."""
    return micro.vdj_parameters(tables.trade_counts(spark, sf_dir), F.lit("all"), micro.LEAST_DAYS, 1.0)


# --- filings by section ----------------------------------------------------------------------------------------------


@query("s16_sections", sql("conv_id section #chunk #n_words chunk_text", """FROM (SELECT conv_id, section, c AS chunk, len(w[c * 448 + 1 : c * 448 + 512]) AS n_words, array_to_string(w[c * 448 + 1 : c * 448 + 512], ' ') AS chunk_text FROM
 (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 512) / 448.0) AS INT)))) AS c FROM (SELECT conv_id, section, flatten(list(w ORDER BY turn)) AS w FROM (SELECT conv_id, turn, ['1', '1A', '7', '7A', '8'][CAST(turn % 5 AS INT) + 1] AS section,
 list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM conversations) WHERE section <> '8' GROUP BY 1, 2) WHERE len(w) > 0))"""))
def s16(spark, sf_dir):
    """Conversations as filings, a turn an item: sections are found by their headings, item 8 is left out."""
    c = tables.read(spark, sf_dir, "conversations")
    items = F.element_at(F.array(*(F.lit(x) for x in ("1", "1A", "7", "7A", "8"))), (F.col("turn") % 5 + 1).cast("int"))
    piece = F.concat(F.lit("ITEM "), items, F.lit(".\n"), F.coalesce("text", F.lit("")))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    d = text.section_chunks(docs, "conv_id")
    return d.select("conv_id", "section", F.col("chunk").cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n_words"), "chunk_text")


# --- the live scores -------------------------------------------------------------------------------------------------

_LIVE = f"""(SELECT date, ticker, lag(close) OVER {W} / nullif(lag(close, 21) OVER {W}, 0) - 1 AS momentum_21d, lag(close) OVER {W} / nullif(lag(close, 63) OVER {W}, 0) - 1 AS momentum_63d, lag(close) OVER {W} / nullif(lag(close, 252) OVER {W}, 0) - 1 AS momentum_252d,
 CASE WHEN l5 = 0 THEN 100 ELSE 100 - 100 / (1 + g5 / l5) END AS rsi_5d, CASE WHEN p20 = 0 THEN 0 ELSE (close - m20) / p20 END AS price_zscore, v20 AS volatility, a20 * 1e6 AS amihud, count(*) OVER (PARTITION BY ticker ORDER BY date) AS bars
 FROM (SELECT *, avg(gain) OVER r5 AS g5, avg(loss) OVER r5 AS l5, avg(close) OVER r20 AS m20, stddev_pop(close) OVER r20 AS p20, stddev_pop(ret) OVER r20 AS v20, CASE WHEN count(il) OVER r20 = 20 THEN avg(il) OVER r20 END AS a20
 FROM (SELECT *, abs(ret) / nullif(lag(close) OVER {W} * volume, 0) AS il FROM t1) WINDOW r5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), r20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)))"""


def _live_z(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR count({c}) OVER (PARTITION BY date) < 2 OR stddev_pop({c}) OVER (PARTITION BY date) = 0 THEN 0 ELSE ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_pop({c}) OVER (PARTITION BY date) END"


_LIVE_NAMES = [f for f in LIVE_WEIGHTS if f not in ("pb_ratio", "roe", "roa", "pin")]


def live_factors(bars: DataFrame, lookback: int = 252) -> DataFrame:
    """The live variant of the technical factors: population deviations, RSI 100 without losses, Amihud on the close before."""
    from alphaloom.functions.expr import change, rolling

    w, c = by_ticker(), F.col("close")
    d = bars.withColumns({"ret": change(c, w), "delta": c - F.lag(c).over(w), "bars": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    gain, loss = (F.when(s * F.col("delta") > 0, s * F.col("delta")).otherwise(0.0) for s in (1, -1))
    g, lo, sd = rolling(gain, 5, F.avg, w), rolling(loss, 5, F.avg, w), rolling(c, 20, F.stddev_pop, w)
    out = {f"momentum_{n}d": ratio(F.lag(c).over(w), F.lag(c, n).over(w)) - 1 for n in (21, 63, 252)}
    out["rsi_5d"] = F.when(lo == 0, 100.0).otherwise(100 - 100 / (1 + ratio(g, lo)))
    out["price_zscore"] = F.when(sd == 0, 0.0).otherwise(ratio(c - rolling(c, 20, F.avg, w), sd))
    out["volatility"] = rolling(F.col("ret"), 20, F.stddev_pop, w)
    out["amihud"] = rolling(ratio(F.abs("ret"), F.lag(c).over(w) * F.col("volume")), 20, F.avg, w) * 1e6
    return d.withColumns(out).filter(F.col("bars") > lookback).drop("delta", "bars")


def live_scores(factors_: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(date, ticker, score): weighted z-scores per date with the population deviation; missing ones count as 0."""
    w = Window.partitionBy("date")
    total = F.lit(0.0)
    for f, weight in weights.items():
        if weight and f in factors_.columns:
            sd = F.stddev_pop(f).over(w)
            ok = F.col(f).isNotNull() & (F.count(f).over(w) >= 2) & (sd != 0)
            total = total + weight * F.when(ok, (F.col(f) - F.avg(f).over(w)) / sd).otherwise(0.0)
    return factors_.select("date", "ticker", total.alias("score"))


@query("x03_live_scores", sql("date ticker ~score", "FROM (SELECT date, ticker, " + " + ".join(f"{LIVE_WEIGHTS[f]} * ({_live_z(f)})" for f in _LIVE_NAMES) + f" AS score FROM (SELECT * FROM {_LIVE} WHERE bars > 252))"))
def x03(spark, sf_dir):
    return live_scores(live_factors(tables.bars(spark, sf_dir)), {f: LIVE_WEIGHTS[f] for f in _LIVE_NAMES})


def live_pin(bars: DataFrame, days: DataFrame, window: int = 60) -> DataFrame:
    """(date, ticker, pin) on ``days`` (date): order-flow fits of each ticker's last ``window`` bars up to there.

    NULL, as no row, where there are fewer bars or where buys or sells are below one a day on average.
    """
    span = F.col("high") - F.col("low")
    share = F.least(F.greatest((F.col("close") - F.col("low")) / F.when(span > 0, span).otherwise(1e-10), F.lit(0.0)), F.lit(1.0))
    flow = bars.select("ticker", "date", F.row_number().over(by_ticker()).alias("no"), (F.col("volume") * share).alias("buys"), (F.col("volume") * (1 - share)).alias("sells"))
    flow = staged(flow, "live-flow")
    asked = flow.join(F.broadcast(days), "date", "left_semi").filter(F.col("no") > window)  # a day a month
    asked = asked.select("ticker", F.col("date").cast("string").alias("window"), F.explode(F.sequence(F.col("no") - window + 1, F.col("no"))).alias("no"))
    d = staged(asked.join(flow, ["ticker", "no"]), "live-windows")
    enough = d.groupBy("ticker", "window").agg(F.avg("buys").alias("b"), F.avg("sells").alias("s")).filter("b >= 1 AND s >= 1").select("ticker", "window")
    fit = micro.ekop_parameters(d.join(enough, ["ticker", "window"], "left_semi"), F.col("window"))
    return fit.select(F.col("window").cast("date").alias("date"), "ticker", "pin")


_ALL_LIVE = f"""(SELECT l.*, p.pb_ratio, p.roe, p.roa, e.pin FROM {_LIVE} l JOIN firsts USING (date) LEFT JOIN full_panel p USING (date, ticker) LEFT JOIN livefit e USING (date, ticker) WHERE bars > 252)"""
_FIRSTS = "firsts AS MATERIALIZED (SELECT min(date) AS date FROM ohlcv GROUP BY date_trunc('month', date))"
_LIVE_DAYS = f"""SELECT n.ticker, 'live' AS period, CAST(n.date AS VARCHAR) AS win, f.date, f.b, f.s FROM lf n JOIN firsts USING (date) JOIN lf f ON f.ticker = n.ticker AND f.no > n.no - 60 AND f.no <= n.no WHERE n.no > 60"""
_LF = f"""lf AS MATERIALIZED (SELECT *, volume * r AS b, volume * (1 - r) AS s FROM (SELECT *, row_number() OVER {W} AS no, least(greatest((close - low) / CASE WHEN high - low > 0 THEN high - low ELSE 1e-10 END, 0), 1) AS r FROM ohlcv))"""


@query("x03_full_live_scores", live_fit_sql("date ticker ~score", "FROM (SELECT date, ticker, " + " + ".join(f"{w} * ({_live_z(f)})" for f, w in LIVE_WEIGHTS.items()) + f" AS score FROM {_ALL_LIVE})", [_FIRSTS, _LF], _LIVE_DAYS))
def x03_full(spark, sf_dir):
    """Live scores on the first day of every month by all weighted factors, fundamentals and the PIN of the last 60 bars included."""
    bars = staged(tables.bars(spark, sf_dir), "live-bars")
    firsts = bars.groupBy(F.trunc("date", "MM").alias("ym")).agg(F.min("date").alias("date")).select("date")
    d = factors.fundamental(live_factors(bars), factors.fundamental_ratios(tables.statements(spark, sf_dir))).join(F.broadcast(firsts), "date", "left_semi")  # a row for each month
    return live_scores(d.join(live_pin(bars, firsts), ["date", "ticker"], "left"), LIVE_WEIGHTS)


_LS = "(SELECT date, ticker, " + " + ".join(f"{LIVE_WEIGHTS[f]} * ({_live_z(f)})" for f in _LIVE_NAMES) + f" AS score FROM (SELECT * FROM {_LIVE} WHERE bars > 252))"


@query("x02_live_targets", sql("date ticker ~weight", f"""FROM (SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, ticker) AS pos FROM
 (SELECT * FROM {_LS} WHERE date IN (SELECT min(date) FROM {_LS} GROUP BY date_trunc('month', date)))) WHERE pos <= 5)"""))
def x02(spark, sf_dir):
    """Monthly rebalancing of the live scores: equal weights of the top five on the first day of each month."""
    s = x03(spark, sf_dir).withColumn("score", F.round("score", 9))
    first = s.groupBy(F.trunc("date", "MM").alias("ym")).agg(F.min("date").alias("date")).select("date")
    top = ranking.top_n(s.join(F.broadcast(first), "date", "left_semi"), 5, "score", "date")  # a row for each month
    return top.select("date", "ticker", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


# --- the event studies on fitted labels --------------------------------------------------------------------------------

for _name in ("b07_event_study", "a10_label_returns", "a11_spread", "a12_label_counts", "a14_two_layer", "a15_sign_consistency", "a16_risk_adjusted", "a21_event_paths", "w15_streaks", "r07_kruskal", "r08_mann_whitney", "r09_welch"):
    query(f"{_name}_fitted", on_fitted_labels(ORACLE_SQL[_name]), exact=True)(events.fitted(QUERIES[_name]))
