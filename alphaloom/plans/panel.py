"""Queries on the factor panel: bars, factors, normalisation, alignment, rank IC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.functions.expr import by_ticker, change, forward_return, ratio
from alphaloom.operators import align, factors, ic, ranking, regime
from alphaloom.registry import query
from alphaloom.sources import tables
from alphaloom.sql import FACTORS, FUNDAMENTAL, W, sql

ALL = FACTORS + FUNDAMENTAL


def technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.technical(tables.bars(spark, sf_dir))


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical and fundamental factors of the rows that have all technical ones."""
    return factors.complete(factors.fundamental(technical(spark, sf_dir), factors.fundamental_ratios(tables.statements(spark, sf_dir))))


def z_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.normalise(raw_panel(spark, sf_dir), ALL)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z_panel(spark, sf_dir).select("date", "ticker", F.round(factors.composite(None, ALL), 9).alias("score"))


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC of every factor and date at 21 days."""
    fwd = ic.forward_returns(tables.bars(spark, sf_dir), [21]).select("date", "ticker", F.col("ret_21d").alias("fwd"))
    return ic.rank_ic(factors.long_form(z_panel(spark, sf_dir), ALL), fwd)


@query("s01_bars", sql("date ticker open high low close volume", "FROM ohlcv"), exact=True)
def s01(spark, sf_dir):
    return tables.bars(spark, sf_dir)


@query("s02_index_prices", sql("date ~spx_close ~vix_close", "FROM idx"))
def s02(spark, sf_dir):
    return tables.index_prices(spark, sf_dir)


@query("s03_fundamentals", sql("ticker known ~eps ~bvps ~roe ~roa", "FROM facts"))
def s03(spark, sf_dir):
    return factors.fundamental_ratios(tables.statements(spark, sf_dir))


@query("s03_statement_labels", sql("ticker known ~eps ~bvps ~roe ~roa", """FROM (WITH f AS (SELECT *, CAST(substr(ticker, 7) AS INT) AS n, year(fiscal_date) % 2 = 1 AS odd FROM stm)
 SELECT ticker, fiscal_date + 60 AS known, CASE WHEN n % 7 = 0 AND bool_or(odd AND ni IS NOT NULL) OVER (PARTITION BY ticker) THEN CASE WHEN odd THEN ni / 1000 END ELSE ni / nullif(shares, 0) END AS eps, equity / nullif(shares, 0) AS bvps, ni / nullif(equity, 0) AS roe, ni / nullif(assets, 0) AS roa FROM f)"""))
def s03_labels(spark, sf_dir):
    """Ratios from statement lines under the names that each ticker uses; reported earnings per share come first."""
    return factors.statement_ratios(tables.statement_facts(spark, sf_dir))


@query("s05_sentiment_daily", sql("ticker date doc_type ~compound", "FROM (SELECT ticker, date, doc_type, avg(compound) AS compound FROM sen GROUP BY 1, 2, 3)"))
def s05(spark, sf_dir):
    return factors.sentiment_daily(tables.sentiment(spark, sf_dir))


@query("s06_event_filings", sql("ticker date ~compound #chunks ~positive ~negative", "FROM (SELECT ticker, date, avg(compound) AS compound, count(*) AS chunks, avg(positive) AS positive, avg(negative) AS negative FROM sen WHERE doc_type = '8-K' GROUP BY 1, 2)"))
def s06(spark, sf_dir):
    s = tables.sentiment(spark, sf_dir).filter("doc_type = '8-K'")
    return s.groupBy("ticker", "date").agg(F.avg("compound").alias("compound"), F.count("*").alias("chunks"), F.avg("positive").alias("positive"), F.avg("negative").alias("negative"))


@query("s07_document_coverage", sql("ticker #k10 #q10 #k8 #news #total", "FROM (SELECT t.ticker, count(*) FILTER (doc_type = '10-K') AS k10, count(*) FILTER (doc_type = '10-Q') AS q10, count(*) FILTER (doc_type = '8-K') AS k8, count(*) FILTER (doc_type = 'news') AS news, count(doc_type) AS total FROM (SELECT DISTINCT p_brand AS ticker FROM part) t LEFT JOIN sen USING (ticker) GROUP BY 1)"))
def s07(spark, sf_dir):
    universe = tables.read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    kinds = {"10-K": "k10", "10-Q": "q10", "8-K": "k8", "news": "news"}
    c = tables.sentiment(spark, sf_dir).groupBy("ticker").pivot("doc_type", list(kinds)).count()
    c = universe.join(c, "ticker", "left").select("ticker", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(v) for k, v in kinds.items()))
    return c.withColumn("total", sum((F.col(v) for v in kinds.values()), F.lit(0)))


@query("s08_remaining_tickers", sql("ticker", "FROM (SELECT DISTINCT p_brand AS ticker FROM part) WHERE ticker NOT IN (SELECT ticker FROM sen WHERE doc_type = '10-K' AND compound < 0)"))
def s08(spark, sf_dir):
    universe = tables.read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return universe.join(tables.sentiment(spark, sf_dir).filter("doc_type = '10-K' AND compound < 0"), "ticker", "left_anti")


@query("s09_store_counts", sql("#rows_ #tickers #days", "FROM (SELECT count(*) AS rows_, count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS days FROM sen)"))
def s09(spark, sf_dir):
    return tables.sentiment(spark, sf_dir).agg(F.count("*").alias("rows_"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("date").alias("days"))


@query("s10_trade_counts", sql("symbol date ~dbuys ~dsells", "FROM taq"))
def s10(spark, sf_dir):
    return tables.trade_counts(spark, sf_dir)


@query("s11_monthly_counts", sql("symbol ym ~dbuys ~dsells #days", "FROM (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS ym, sum(dbuys) AS dbuys, sum(dsells) AS dsells, count(*) AS days FROM lines GROUP BY 1, 2)"))
def s11(spark, sf_dir):
    d = tables.line_counts(spark, sf_dir).groupBy("symbol", F.trunc("date", "MM").alias("ym"))
    return d.agg(F.sum("dbuys").alias("dbuys"), F.sum("dsells").alias("dsells"), F.count("*").alias("days"))


@query("s18_upsert_chunks", sql("chunk_id ticker ~compound", "FROM (SELECT chunk_id, ticker, coalesce(CASE WHEN doc_type = 'news' THEN 0.5 END, compound) AS compound FROM sen)"))
def s18(spark, sf_dir):
    from alphaloom.sources.files import upsert

    s = tables.sentiment(spark, sf_dir).withColumn("version", F.lit(1))
    fresh = s.filter("doc_type = 'news'").withColumn("compound", F.lit(0.5)).withColumn("version", F.lit(2))
    return upsert(s, fresh, "chunk_id", "version").select("chunk_id", "ticker", "compound")


for _f in FACTORS:

    @query(f"w_{_f}", sql(f"date ticker ~{_f}", "FROM tech"))
    def technical_factor(spark, sf_dir, _f=_f):
        return technical(spark, sf_dir).select("date", "ticker", _f)


@query("w01_daily_change", sql("date ticker ~ret", "FROM t0"))
def w01(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("date", "ticker", change(F.col("close"), by_ticker()).alias("ret"))


@query("j04_asof_fundamentals", sql("date ticker ~pe_ratio ~pb_ratio ~roe ~roa", "FROM full_panel"))
def j04(spark, sf_dir):
    p = factors.fundamental(tables.bars(spark, sf_dir).select("date", "ticker", "close"), factors.fundamental_ratios(tables.statements(spark, sf_dir)))
    return p.select("date", "ticker", *FUNDAMENTAL)


@query("p03_complete_panel", sql("date ticker " + " ".join(f"~{f}" for f in ALL), "FROM panel"))
def p03(spark, sf_dir):
    return raw_panel(spark, sf_dir).select("date", "ticker", *ALL)


@query("p12_buy_sell_volume", sql("date ticker ~buys ~sells", "FROM flow"))
def p12(spark, sf_dir):
    return factors.buy_sell_volume(tables.bars(spark, sf_dir)).select("date", "ticker", "buys", "sells")


@query("p08_sentiment_buckets", sql("bucket #n ~mean_compound", "FROM (SELECT CASE WHEN c <= -0.05 THEN 'Negative' WHEN c <= 0.05 THEN 'Neutral' ELSE 'Positive' END AS bucket, count(*) AS n, avg(c) AS mean_compound FROM (SELECT avg(compound) AS c FROM sen WHERE compound IS NOT NULL GROUP BY ticker, date) GROUP BY 1)"))
def p08(spark, sf_dir):
    d = tables.sentiment(spark, sf_dir).filter("compound IS NOT NULL").groupBy("ticker", "date").agg(F.avg("compound").alias("c"))
    return d.groupBy(ranking.sentiment_bucket(F.col("c")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("c").alias("mean_compound"))


@query("p14_coverage", sql("factor ~coverage", "FROM (UNPIVOT (SELECT " + ", ".join(f"avg(CAST({f} IS NOT NULL AS DOUBLE)) AS {f}" for f in ALL) + " FROM panel) ON COLUMNS(*) INTO NAME factor VALUE coverage)"))
def p14(spark, sf_dir):
    return factors.coverage(raw_panel(spark, sf_dir), ALL)


@query("w10_cross_sectional_z", sql("date ticker " + " ".join(f"~{f}" for f in ALL), "FROM zs"))
def w10(spark, sf_dir):
    return z_panel(spark, sf_dir).select("date", "ticker", *ALL)


@query("w11_sector_neutral_z", sql("date ticker " + " ".join(f"~{f}" for f in ALL), "FROM zsec"))
def w11(spark, sf_dir):
    return factors.normalise(raw_panel(spark, sf_dir), ALL, tables.sectors(spark, sf_dir)).select("date", "ticker", *ALL)


_DAY = "SELECT ticker, date, avg(c) AS compound FROM (SELECT ticker, date, doc_type, avg(compound) AS c FROM sen GROUP BY 1, 2, 3) GROUP BY 1, 2"
_GRID = f"SELECT d.date, t.ticker, compound FROM (SELECT date FROM ohlcv UNION SELECT date FROM ({_DAY})) d CROSS JOIN (SELECT DISTINCT ticker FROM ({_DAY})) t LEFT JOIN ({_DAY}) USING (date, ticker)"
_FILLED = f"SELECT date, ticker, last_value(compound IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) AS f FROM ({_GRID})"


@query("w12_bounded_fill", sql("date ticker ~filled", f"FROM (SELECT date, ticker, lag(f) OVER {W} AS filled FROM (SELECT * FROM ({_FILLED}) WHERE date IN (SELECT date FROM ohlcv)))"))
def w12(spark, sf_dir):
    daily = tables.sentiment(spark, sf_dir).groupBy("ticker", "date", "doc_type").agg(F.avg("compound").alias("c")).groupBy("ticker", "date").agg(F.avg("c").alias("filled"))
    return align.bounded_fill(daily, tables.bars(spark, sf_dir), factors.FILING_FILL, ["filled"])


@query("a01_mean_of_means", sql("ticker date ~compound", "FROM (SELECT ticker, date, avg(c) AS compound FROM (SELECT ticker, date, doc_type, avg(compound) AS c FROM sen GROUP BY 1, 2, 3) GROUP BY 1, 2)"))
def a01(spark, sf_dir):
    return factors.sentiment_daily(tables.sentiment(spark, sf_dir)).groupBy("ticker", "date").agg(F.avg("compound").alias("compound"))


@query("a02_market_return", sql("date ~mkt", "FROM (SELECT date, avg(ret) AS mkt FROM t0 GROUP BY 1)"))
def a02(spark, sf_dir):
    return s01_returns(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("mkt"))


def s01_returns(spark, sf_dir):
    return tables.bars(spark, sf_dir).withColumn("ret", change(F.col("close"), by_ticker()))


@query("a20_composite", sql("date ticker ~score", "FROM score"))
def a20(spark, sf_dir):
    return scores(spark, sf_dir)


@query("a20_composite_unweighted", sql("date ticker ~score", "FROM (SELECT date, ticker, list_avg([" + ", ".join(ALL) + "]) AS score FROM zs)"))
def a20_mean(spark, sf_dir):
    return z_panel(spark, sf_dir).select("date", "ticker", factors.composite({}, ALL).alias("score"))


@query("w14_forward_returns", sql("date ticker ~fwd", "FROM fwd"))
def w14(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("date", "ticker", forward_return(F.col("close"), 21, by_ticker()).alias("fwd"))


@query("r01_rank_ic", sql("factor date ~ic #n", "FROM ic"))
def r01(spark, sf_dir):
    return information(spark, sf_dir)


@query("a08_ic_summary", sql("factor #n ~mean_ic ~std_ic ~positive ~icir ~t_stat", "FROM icsum"))
def a08(spark, sf_dir):
    return ic.ic_summary(information(spark, sf_dir))


@query("r28_factor_selection", sql("factor weight", "FROM (SELECT factor, CASE WHEN t_stat IS NULL OR abs(t_stat) < 2 THEN 0 WHEN icir >= 0 THEN 1 ELSE -1 END AS weight FROM icsum)"))
def r28(spark, sf_dir):
    return ic.select_factors(ic.ic_summary(information(spark, sf_dir))).select("factor", "weight")


@query("w13_cumulative_ic", sql("factor date ~cumulative", "FROM (SELECT factor, date, sum(ic) OVER (PARTITION BY factor ORDER BY date) AS cumulative FROM ic WHERE ic IS NOT NULL)"))
def w13(spark, sf_dir):
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return information(spark, sf_dir).filter("ic IS NOT NULL").select("factor", "date", F.sum("ic").over(w).alias("cumulative"))


@query("r03_mutual_information")
def r03(spark, sf_dir):
    fwd = ic.forward_returns(tables.bars(spark, sf_dir), [21]).select("date", "ticker", F.col("ret_21d").alias("fwd"))
    return ic.factor_mi(factors.long_form(z_panel(spark, sf_dir), ALL), fwd)


@query("a09_combined_ic_mi")
def a09(spark, sf_dir):
    return ic.combined(ic.ic_summary(information(spark, sf_dir)), r03(spark, sf_dir))


@query("r24_regime_detail", sql("date ~spx_close ~vix_close ~ma200 ~mom_12m vix_high below_ma falling bear_count", "FROM rd"))
def r24(spark, sf_dir):
    return regime.regime_detail(tables.index_prices(spark, sf_dir))


@query("r25_regime_multiplier", sql("date ~multiplier", "FROM mult"))
def r25(spark, sf_dir):
    return regime.multiplier(tables.index_prices(spark, sf_dir))


@query("p11_business_day_scores", sql("date bear_score", "FROM mult"))
def p11(spark, sf_dir):
    return regime.bear_scores(tables.index_prices(spark, sf_dir))


@query("a23_regime_share", sql("~full_ ~half ~off", "FROM (SELECT avg(CAST(multiplier = 1 AS DOUBLE)) AS full_, avg(CAST(multiplier = 0.5 AS DOUBLE)) AS half, avg(CAST(multiplier = 0 AS DOUBLE)) AS off FROM mult)"))
def a23(spark, sf_dir):
    share = lambda v: F.avg((F.col("multiplier") == v).cast("double"))
    return r25(spark, sf_dir).agg(share(1.0).alias("full_"), share(0.5).alias("half"), share(0.0).alias("off"))


_M = """FROM (SELECT ticker, ym, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ym), 0) - 1 AS ret FROM (SELECT m.ticker, m.ym, close FROM (SELECT ticker, CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE) AS ym FROM ohlcv GROUP BY ticker) m
 LEFT JOIN (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS ym, arg_max(close, date) AS close FROM ohlcv GROUP BY 1, 2) c USING (ticker, ym)))"""


def monthly_returns(spark, sf_dir):
    """(ticker, ym, ret): change of the last close of each month; a month without trades breaks the chain."""
    b = tables.bars(spark, sf_dir)
    last = b.groupBy("ticker", F.trunc("date", "MM").alias("ym")).agg(F.max_by("close", "date").alias("close"))
    months = last.groupBy("ticker").agg(F.explode(F.sequence(F.min("ym"), F.max("ym"), F.expr("interval 1 month"))).alias("ym"))
    w = Window.partitionBy("ticker").orderBy("ym")
    return months.join(last, ["ticker", "ym"], "left").select("ticker", "ym", (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))


@query("a22_monthly_returns", sql("ticker ym ~ret", _M))
def a22(spark, sf_dir):
    return monthly_returns(spark, sf_dir)


_Q = _M.removeprefix("FROM ")
_QT = f"""(SELECT ticker, ym, flow_, nxt, CASE WHEN flow_ <= e[2] THEN 1 WHEN flow_ <= e[3] THEN 2 WHEN flow_ <= e[4] THEN 3 WHEN flow_ <= e[5] THEN 4 ELSE 5 END AS bucket FROM
 (SELECT a.ticker, a.ym, flow_, r.ret AS nxt, quantile_cont(flow_, [0, 0.2, 0.4, 0.6, 0.8, 1]) OVER (PARTITION BY a.ym) AS e FROM (SELECT symbol AS ticker, CAST(date_trunc('month', date) AS DATE) AS ym, sum(dbuys) / sum(dbuys + dsells) AS flow_ FROM lines GROUP BY 1, 2) a
 JOIN {_Q} r ON a.ticker = r.ticker AND r.ym = a.ym + INTERVAL 1 MONTH WHERE r.ret IS NOT NULL) WHERE len(list_distinct(e)) = 6)"""


def next_month(spark, sf_dir):
    """(ticker, ym, flow_, nxt): share of buys in a month joined with the next month's return."""
    share = F.sum("dbuys") / F.sum(F.col("dbuys") + F.col("dsells"))
    a = tables.line_counts(spark, sf_dir).groupBy(F.col("symbol").alias("ticker"), F.trunc("date", "MM").alias("ym")).agg(share.alias("flow_"))
    r = monthly_returns(spark, sf_dir).select("ticker", F.add_months("ym", -1).alias("ym"), F.col("ret").alias("nxt")).filter("nxt IS NOT NULL")
    return a.join(r, ["ticker", "ym"])


@query("w17_quantile_buckets", sql("ticker ym ~flow_ ~nxt bucket", f"FROM {_QT}"))
def w17(spark, sf_dir):
    return ranking.quantile_bucket(next_month(spark, sf_dir), "flow_", "ym").select("ticker", "ym", "flow_", "nxt", "bucket")


@query("a17_quintile_table", sql("bucket #n ~mean_ ~sd ~se ~t_stat", f"FROM (SELECT bucket, count(*) AS n, avg(nxt) * 100 AS mean_, stddev_samp(nxt) AS sd, stddev_samp(nxt) / sqrt(count(*)) * 100 AS se, avg(nxt) / nullif(stddev_samp(nxt) / sqrt(count(*)), 0) AS t_stat FROM {_QT} GROUP BY 1)"))
def a17(spark, sf_dir):
    g = w17(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("nxt").alias("m"), F.stddev_samp("nxt").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return g.select("bucket", "n", (F.col("m") * 100).alias("mean_"), "sd", (se * 100).alias("se"), ratio(F.col("m"), se).alias("t_stat"))


@query("t06_seeded_sample", sql("ticker date ~close", "FROM (SELECT ticker, date, close FROM ohlcv ORDER BY md5('7|' || ticker || '|' || CAST(date AS VARCHAR)), ticker, date LIMIT 300)"))
def t06(spark, sf_dir):
    return ranking.seeded_sample(tables.bars(spark, sf_dir).select("ticker", "date", "close"), 300, 7, "ticker", "date")


@query("t01_top_names", sql("date ticker ~score pos", "FROM (SELECT date, ticker, score, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, ticker) AS INT) AS pos FROM score) WHERE pos <= 5"))
def t01(spark, sf_dir):
    return ranking.top_n(scores(spark, sf_dir), 5, "score", "date")


@query("u03_date_sets", sql("#in_both #in_either #bars_only", "FROM (SELECT (SELECT count(*) FROM (SELECT date FROM ohlcv INTERSECT SELECT date FROM idx)) AS in_both, (SELECT count(*) FROM (SELECT date FROM ohlcv UNION SELECT date FROM idx)) AS in_either, (SELECT count(*) FROM (SELECT date FROM ohlcv EXCEPT SELECT date FROM idx)) AS bars_only)"))
def u03(spark, sf_dir):
    a, b = tables.bars(spark, sf_dir).select("date", F.lit(1).alias("a")).distinct(), tables.index_prices(spark, sf_dir).select("date", F.lit(1).alias("b"))
    j = a.join(b, "date", "full")
    return j.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("in_both"), F.count("*").alias("in_either"), F.count(F.when(F.col("b").isNull(), 1)).alias("bars_only"))
