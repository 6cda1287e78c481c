"""Panels derived from the star-schema tables: bars, index, fundamentals, trade counts, sentiment."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import staged

#: The tables that the query being built has staged; None: nothing is.
_STAGED: ContextVar = ContextVar("staged", default=None)


def read_once(query_: Callable) -> Callable:
    """The query ``query_``, which aggregates trades and orders once for each derived table, however many branches of its plans read it."""

    @wraps(query_)
    def run(spark, sf_dir):
        if _STAGED.get() is not None:
            return query_(spark, sf_dir)
        mark = _STAGED.set({})
        try:
            return query_(spark, sf_dir)
        finally:
            _STAGED.reset(mark)

    return run


def _derived(make: Callable) -> Callable:
    """A table of a row for each day or year; within ``read_once`` it is staged at its first use."""

    @wraps(make)
    def run(spark, sf_dir, *more):
        held, key = _STAGED.get(), (make.__name__, sf_dir, *more)
        if held is None:
            return make(spark, sf_dir, *more)
        if key not in held:
            held[key] = staged(make(spark, sf_dir, *more), make.__name__.replace("_", "-"))
        return held[key]

    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_derived
def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """(date, ticker, open, high, low, close, volume): one bar per traded day and ticker."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col(ticker).alias("ticker"))
    line = read(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("q"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("o"),
    )
    trades = line.join(part, line.l_partkey == part.p_partkey)
    return trades.groupBy("date", "ticker").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "o").alias("close"), F.sum("q").alias("volume"),
    )


@_derived
def index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, spx_close, vix_close): a market index and a volatility index."""
    o = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
    return o.agg(F.avg("o_totalprice").alias("spx_close"), (F.lit(20.0) + F.count("*") % 12).alias("vix_close"))


@_derived
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, fiscal_date, ni, equity, assets, shares): yearly statements; one ticker reports no shares, one zero."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    line = read(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), "l_extendedprice", "l_discount", "l_tax")
    ep = F.col("l_extendedprice")
    g = line.join(part, line.l_partkey == part.p_partkey).groupBy("ticker", "y").agg(
        (F.sum(ep * (1 - F.col("l_discount"))) - 1e6 * (F.col("y") % 3)).alias("ni"), F.sum(ep).alias("equity"),
        F.sum(ep * (1 + F.col("l_tax"))).alias("assets"), F.count("*").cast("double").alias("n"),
    )
    shares = F.when(F.col("ticker") == "Brand#11", F.lit(None)).when(F.col("ticker") == "Brand#12", 0.0).otherwise(F.col("n"))
    return g.select("ticker", F.make_date("y", F.lit(12), F.lit(31)).alias("fiscal_date"), "ni", "equity", "assets", shares.alias("shares"))


def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, fiscal_date, label, value): the statements as lines whose names differ from ticker to ticker."""
    n = F.substring("ticker", 7, 9).cast("int")
    name = lambda test, a, b: F.when(test, a).otherwise(b)
    line = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    c = F.col
    lines = [
        line(name(n % 2 == 1, "NetIncome", "Net Income"), c("ni")), line(name(n % 4 == 1, "Total Stockholder Equity", "Stockholders Equity"), c("equity")), line(F.lit("Total Assets"), c("assets")),
        line(name(n % 5 == 0, "Share Issued", "Ordinary Shares Number"), c("shares")), line(name(n % 3 == 0, "Common Stock Equity", "Other"), c("equity") / 2),
        line(name((n % 7 == 0) & (F.year("fiscal_date") % 2 == 1), "Diluted EPS", "Other"), c("ni") / 1000),
    ]
    return statements(spark, sf_dir).select("ticker", "fiscal_date", F.explode(F.array(*lines)).alias("x")).select("ticker", "fiscal_date", "x.*")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector); two tickers have none."""
    n = F.substring("p_brand", 7, 9).cast("int")
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), n.alias("n")).distinct()
    return p.filter("n < 24").select("ticker", (F.col("n") % 5).cast("string").alias("sector"))


def trade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, dbuys, dsells): daily buy and sell counts."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("S"), F.col("user_id") % 10).alias("symbol"), F.to_date("ts").alias("date"), "event_type")
    count = lambda *kinds: F.sum(F.col("event_type").isin(*kinds).cast("int")).cast("double")
    return e.groupBy("symbol", "date").agg(count("purchase", "signup").alias("dbuys"), count("click", "error").alias("dsells"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, dbuys, dsells) over years: order lines by return flag."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    line = read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_returnflag")
    g = line.join(part, line.l_partkey == part.p_partkey).groupBy("symbol", "date")
    sold = F.sum((F.col("l_returnflag") == "N").cast("int")).cast("double")
    return g.agg((F.count("*") - sold).alias("dbuys"), sold.alias("dsells"))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, doc_type, chunk_id, positive, negative, compound) of every scored document."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    kinds = F.array(*(F.lit(x) for x in ("10-K", "10-Q", "8-K", "news")))
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.concat(F.lit("Brand#"), F.col("doc_id") % 25 + 1).alias("ticker"), F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") * 37 % 2499).cast("int")).alias("date"),
        F.element_at(kinds, (F.substring("source", 4, 9).cast("int") % 4 + 1)).alias("doc_type"), F.col("doc_id").alias("chunk_id"),
        F.col("quality").cast("double").alias("positive"), F.col("toxic").cast("double").alias("negative"), (F.col("quality") - F.col("toxic")).cast("double").alias("compound"),
    )
