"""Alpha factors on long panels: technical, fundamental, sentiment; normalisation and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.expr import by_ticker, change, ratio, rolling, rolling_z, standard
from alphaloom.operators.align import asof_backward, bounded_fill

# fixed values: default composite weights, regime weights and the factors a row must have
TECHNICAL = ["momentum_21d", "momentum_63d", "momentum_252d", "rsi_5d", "price_zscore_20d", "volatility_20d", "volume_zscore_20d", "amihud_20d"]
DEFAULT_WEIGHTS = {"momentum_252d": 1, "volatility_20d": 1, "volume_zscore_20d": -1, "amihud_20d": -1, "pb_ratio": 1, "pin": -1, "news_sentiment": 1, "filing_sentiment": 1}
FILING_LAG_DAYS = 60
FILING_FILL, NEWS_FILL = 90, 5


def technical(bars: DataFrame, lags: tuple[int, ...] = (21, 63, 252)) -> DataFrame:
    """``bars`` with ret and the technical factors; all windows share one exchange and one sort."""
    w = by_ticker()
    c, v = F.col("close"), F.col("volume")
    d = bars.withColumns({"ret": change(c, w), "delta": c - F.lag(c).over(w)})
    gain, loss = (F.when(s * F.col("delta") > 0, s * F.col("delta")).otherwise(0.0) for s in (1, -1))
    g, lo = rolling(gain, 5, F.avg, w), rolling(loss, 5, F.avg, w)
    out = {f"momentum_{n}d": ratio(F.lag(c, 1).over(w), F.lag(c, n).over(w)) - 1 for n in lags}
    out["rsi_5d"] = F.when(lo > 0, 100 - 100 / (1 + ratio(g, lo))).when(g > 0, F.lit(100.0))
    out["price_zscore_20d"] = rolling_z(c, 20, w)
    out["volatility_20d"] = rolling(F.col("ret"), 20, F.stddev_samp, w)
    out["volume_zscore_20d"] = rolling_z(v, 20, w)
    out["amihud_20d"] = rolling(ratio(F.abs("ret"), c * v), 20, F.avg, w) * 1e6
    return d.withColumns(out).drop("delta")


def fundamental_ratios(statements: DataFrame) -> DataFrame:
    """(ticker, known, eps, bvps, roe, roa) from yearly statements, known 60 days after the fiscal date."""
    shares, equity = F.col("shares"), F.col("equity")
    return statements.select(
        "ticker", F.date_add("fiscal_date", FILING_LAG_DAYS).alias("known"), ratio(F.col("ni"), shares).alias("eps"), ratio(equity, shares).alias("bvps"),
        ratio(F.col("ni"), equity).alias("roe"), ratio(F.col("ni"), F.col("assets")).alias("roa"),
    )


#: Names of statement items, the first that a ticker reports counts; fixed values.
STATEMENT_LABELS = {
    "net_income": ("Net Income", "NetIncome"),
    "equity": ("Stockholders Equity", "Total Stockholder Equity", "Common Stock Equity", "Total Equity Gross Minority Interest"),
    "assets": ("Total Assets",),
    "shares": ("Ordinary Shares Number", "Share Issued"),
    "reported_eps": ("Basic EPS", "Diluted EPS"),
}


def statement_ratios(facts: DataFrame) -> DataFrame:
    """(ticker, known, eps, bvps, roe, roa) from statement lines (ticker, fiscal_date, label, value).

    Of the names of an item the first one with any value counts for all dates of a ticker. A ticker that reports earnings per share has these
    and no others; else net income is divided by shares. A ratio needs both parts on one fiscal date; missing values and NaN are no values.
    """
    names = [(item, label, i) for item, labels in STATEMENT_LABELS.items() for i, label in enumerate(labels)]
    d = facts.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(facts.sparkSession.createDataFrame(names, "item string, label string, place int")), "label")  # eleven names
    first = d.groupBy("ticker", "item").agg(F.min("place").alias("place"))
    d = d.join(first, ["ticker", "item", "place"])
    wide = d.groupBy("ticker", "fiscal_date").pivot("item", list(STATEMENT_LABELS)).agg(F.max("value"))
    reports = first.filter("item = 'reported_eps'").select("ticker", F.lit(True).alias("_reports"))
    c = F.col
    out = wide.join(reports, "ticker", "left").select(
        "ticker", F.date_add("fiscal_date", FILING_LAG_DAYS).alias("known"), F.when(c("_reports"), c("reported_eps")).otherwise(ratio(c("net_income"), c("shares"))).alias("eps"),
        ratio(c("equity"), c("shares")).alias("bvps"), ratio(c("net_income"), c("equity")).alias("roe"), ratio(c("net_income"), c("assets")).alias("roa"),
    )
    return out.filter("eps IS NOT NULL OR bvps IS NOT NULL OR roe IS NOT NULL OR roa IS NOT NULL")


def fundamental(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """``panel`` with pe_ratio, pb_ratio, roe, roa as known on each date; a loss has no PE."""
    p = asof_backward(panel, facts, "ticker", "date", "known", ["eps", "bvps", "roe", "roa"])
    pe = ratio(F.col("close"), F.when(F.col("eps") > 0, F.col("eps")))
    return p.withColumns({"pe_ratio": pe, "pb_ratio": ratio(F.col("close"), F.col("bvps"))}).drop("eps", "bvps")


def sentiment_daily(chunks: DataFrame) -> DataFrame:
    """(ticker, date, doc_type, compound): mean over the chunks of a day."""
    return chunks.groupBy("ticker", "date", "doc_type").agg(F.avg("compound").alias("compound"))


def sentiment_factors(chunks: DataFrame, days: DataFrame) -> DataFrame:
    """(date, ticker, news_sentiment, filing_sentiment): mean of the document types' means, filled, a day later."""
    kind = F.when(F.col("doc_type") == "news", F.lit("news_sentiment")).otherwise(F.lit("filing_sentiment"))
    daily = sentiment_daily(chunks).withColumn("kind", kind).groupBy("ticker", "date").pivot("kind", ["news_sentiment", "filing_sentiment"]).agg(F.avg("compound"))
    news = bounded_fill(daily.select("ticker", "date", "news_sentiment").dropna(), days, NEWS_FILL, ["news_sentiment"])
    filing = bounded_fill(daily.select("ticker", "date", "filing_sentiment").dropna(), days, FILING_FILL, ["filing_sentiment"])
    return news.join(filing, ["date", "ticker"], "full")


def normalise(panel: DataFrame, factors: list[str], sectors: DataFrame | None = None) -> DataFrame:
    """Cross-sectional z-scores per date, or per date and sector (two values at least, unmapped tickers in one sector)."""
    if sectors is None:
        w = Window.partitionBy("date")
        return panel.withColumns({f: standard(F.col(f), w) for f in factors})
    p = panel.join(F.broadcast(sectors), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    w = Window.partitionBy("date", "sector")
    return p.withColumns({f: standard(F.col(f), w, 2) for f in factors})


def complete(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=[c for c in TECHNICAL if c in panel.columns])


def composite(weights: dict[str, float] | None, columns: list[str]) -> Column:
    """Weighted sum of the present factors with non-zero weight, missing values as 0; without any, the mean of all factors."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    active = [(f, w) for f, w in weights.items() if w and f in columns]
    if active:
        return sum((F.coalesce(F.col(f), F.lit(0.0)) * F.lit(float(w)) for f, w in active), F.lit(0.0))
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return ratio(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))


def long_form(panel: DataFrame, factors: list[str], *keys: str) -> DataFrame:
    """(date, ticker, factor, value)."""
    return panel.unpivot(["date", "ticker", *keys], factors, "factor", "value")


def coverage(panel: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, coverage): share of rows with a value."""
    wide = panel.agg(*(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in factors))
    return wide.unpivot([], factors, "factor", "coverage")


def buy_sell_volume(bars: DataFrame) -> DataFrame:
    """Bulk volume classification: the close's place in the day's range splits the volume."""
    r = F.least(F.greatest((F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-10), F.lit(0.0)), F.lit(1.0))
    return bars.withColumns({"buys": F.col("volume") * r, "sells": F.col("volume") * (1 - r)})
