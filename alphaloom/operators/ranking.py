"""Ranking operators: top-n, quantile buckets, seeded samples, streaks, smoothers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.operators import information
from alphaloom.session import staged


def top_n(df: DataFrame, n: int, by: str, *keys: str, tie: str = "ticker", bottom: bool = False) -> DataFrame:
    """The n largest (or smallest) rows per key; missing values last, ties by ``tie``."""
    order = F.col(by).asc_nulls_last() if bottom else F.col(by).desc_nulls_last()
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).filter(F.col("pos") <= n)


def quantile_bucket(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """Right-closed linear-quantile buckets 1..n per key; keys with repeated edges drop out."""
    at = F.array(*(F.lit(i / n) for i in range(n + 1)))
    edges = df.groupBy(key).agg(F.percentile(value, at).alias("edges")).filter(F.size(F.array_distinct("edges")) == n + 1)
    bucket = F.lit(1)
    for i in range(1, n):
        bucket = bucket + (F.col(value) > F.element_at("edges", i + 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).join(edges, key).withColumn("bucket", bucket).drop("edges")


def seeded_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, the same at any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), *keys).limit(n)


def streaks(df: DataFrame, value: str, key: str = "ticker", at: str = "date") -> DataFrame:
    """``df`` with the length so far of each run of equal values, and its bucket ('5+' from 5)."""
    w = Window.partitionBy(key).orderBy(at)
    d = df.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_run").orderBy(at)))
    return d.withColumn("streak_bucket", F.when(F.col("streak") >= 5, "5+").otherwise(F.col("streak").cast("string"))).drop("_new", "_run")


def pooled_ranks(counts: DataFrame, value: str, *keys: str, blocks: int = 64) -> DataFrame:
    """``counts`` (keys, value, t, more), one row per distinct value standing for t rows, with the mean rank ``r`` of these.

    For few keys over very many rows: values fall into blocks between approximate quantiles, each block is ranked for itself
    and starts after the rows of the blocks before it, so no task sorts a whole key. Keys and values are not NULL.
    """
    by = list(keys) or ["_all"]
    c = counts if keys else counts.withColumn("_all", F.lit(1))
    edges = c.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(i / blocks) for i in range(1, blocks))), F.lit(1000)).alias("_edges"))
    c = c.join(edges if keys else F.broadcast(edges), by)  # one row without keys
    c = c.withColumn("_block", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sizes = c.groupBy(*by, "_block").agg(F.sum("t").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # at most ``blocks`` rows
    c = c.join(sizes.select(*by, "_block", F.coalesce(before, F.lit(0)).alias("_before")), [*by, "_block"])
    within = F.sum("t").over(Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("r", F.col("_before") + within - (F.col("t") - 1) / 2.0).drop("_block", "_before", "_all")


def smoothed(df: DataFrame, x: str, y: str, window: int | None, step: int, *ties: str) -> DataFrame:
    """Means of y over windows of rows in the order of x, every ``step`` rows; a window of None is a 15th of the rows, at least 30.

    Running sums over blocks of the order: a window's mean is the difference of two of them, so no task sorts all rows.
    """
    d = staged(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"), *(c for c in ties if c not in (x, y))), "smoother-rows")
    rows, order = d.count(), ["_x", *(c for c in ties if c not in (x, y))]
    window = window or max(30, rows // 15)
    d = information.ordered(d, [], order, "smoother", information.BLOCK, rows)
    parts = {"no": F.lit(1), "sx": F.col("_x").cast("double"), "sy": F.col("_y").cast("double")}
    upto = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = d.groupBy("_block").agg(*(F.sum(v).alias(c) for c, v in parts.items())).select("_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}0") for c in parts))
    d = d.select("_block", *(F.sum(v).over(upto).alias(c) for c, v in parts.items())).join(sums, "_block")
    d = staged(d.select(*((F.col(c) + F.col(f"_{c}0")).alias(c) for c in parts)), "smoother-sums")
    at = lambda shift, name: d.select((F.col("no") + shift).alias("row_no"), F.col("sx").alias(f"{name}x"), F.col("sy").alias(f"{name}y"))
    out = at(1 - window, "h").filter((F.col("row_no") >= 1) & ((F.col("row_no") - 1) % step == 0)).join(at(1, "l"), "row_no", "left")
    mean = lambda c: ((F.col(f"h{c}") - F.coalesce(f"l{c}", F.lit(0.0))) / window).alias(c)
    return out.select("row_no", mean("x"), mean("y"))


def sentiment_bucket(x: Column) -> Column:
    return F.when(x <= -0.05, "Negative").when(x <= 0.05, "Neutral").when(x.isNotNull(), "Positive")
