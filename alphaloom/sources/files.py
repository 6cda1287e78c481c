"""File readers and idempotent sinks: bars and trade counts from CSV or Parquet, text folders, upserts, cached results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.session import no_nan

BARS = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
COUNTS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), T.StructField("dbuys", T.DoubleType()), T.StructField("dsells", T.DoubleType())])


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", tickers: list[str] | None = None, start: str | None = None, end: str | None = None, warm_up_days: int = 0) -> DataFrame:
    """Bars in a date range, read ahead by ``warm_up_days``; filters reach the scan."""
    reader = spark.read.schema(BARS)
    df = reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)
    if tickers:
        df = df.filter(F.col("ticker").isin(tickers))
    if start:
        df = df.filter(F.col("date") >= F.date_sub(F.lit(start).cast("date"), warm_up_days))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return no_nan(df)


def read_counts(spark: SparkSession, paths: str | list[str], symbols: list[str] | None = None) -> DataFrame:
    """Trade counts from CSV files (globs allowed): needed columns only, rows without counts dropped."""
    df = spark.read.schema(COUNTS).csv(paths, header=True)
    df = df.filter(F.col("symbol").isin(symbols)) if symbols else df
    return no_nan(df).dropna(subset=["dbuys", "dsells"]).withColumns({"total": F.col("dbuys") + F.col("dsells"), "ym": F.trunc("date", "MM")})


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file below ``path``."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Union of both with the newest row of each key; ``new`` wins ties of ``version``."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_side").desc())
    return both.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "_side")
