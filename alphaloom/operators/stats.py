"""Hypothesis tests and group statistics as native aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.functions.expr import correlation, ratio
from alphaloom.operators.ranking import pooled_ranks
from alphaloom.session import staged


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, mean_, median_, sd, sem)."""
    x = F.col(value)
    return df.filter(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean_"), F.median(x).alias("median_"), F.stddev_samp(x).alias("sd"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"))


def spread(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, mean_, median_, sd_pop, q25, q75) with linear quantiles."""
    x, q = F.col(value), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    g = df.filter(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean_"), F.median(x).alias("median_"), F.stddev_pop(x).alias("sd_pop"), q.alias("q"))
    return g.select(*keys, "n", "mean_", "median_", "sd_pop", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))


def welch(df: DataFrame, value: str, label: str, a, b, *keys: str) -> DataFrame:
    """(keys, na, nb, diff, t_stat, dof, cohen_d) of the groups label = a and label = b."""
    part = lambda f, v: f(F.when(F.col(label) == v, F.col(value)))
    g = df.groupBy(*keys).agg(*(part(f, v).alias(f"{n}{s}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for s, v in (("a", a), ("b", b))))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    dof = ratio((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    diff = F.col("ma") - F.col("mb")
    return g.filter("na > 1 AND nb > 1").select(*keys, "na", "nb", diff.alias("diff"), ratio(diff, F.sqrt(ea + eb)).alias("t_stat"), dof.alias("dof"), ratio(diff, pooled).alias("cohen_d"))


def paired(df: DataFrame, diff: str, *keys: str) -> DataFrame:
    """(keys, n, mean_, t_stat, cohen_dz): one-sample t of paired differences."""
    x = F.col(diff)
    g = df.filter(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean_"), F.stddev_samp(x).alias("sd"))
    return g.select(*keys, "n", "mean_", ratio(F.col("mean_") * F.sqrt("n"), F.col("sd")).alias("t_stat"), ratio(F.col("mean_"), F.col("sd")).alias("cohen_dz"))


def kruskal(df: DataFrame, value: str, label: str, *keys: str) -> DataFrame:
    """(keys, n, k, h, eta2): Kruskal-Wallis H with tie correction over the label's groups."""
    d = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, value, label).agg(F.count("*").alias("c"))
    d = staged(d, "values")  # read for blocks, ranks and sums
    ranks = pooled_ranks(d.groupBy(*keys, value).agg(F.sum("c").alias("t")), value, *keys)
    sums = d.join(ranks.select(*keys, value, "r"), [*keys, value]).groupBy(*keys, label).agg(F.sum(F.col("r") * F.col("c")).alias("s"), F.sum("c").cast("double").alias("c"))
    sums = sums.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"))
    t = F.col("t").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("ties"))
    j = sums.join(ties, list(keys)) if keys else sums.crossJoin(F.broadcast(ties))  # one row each
    n = F.col("n")
    h = ratio(12 * F.col("q") / (n * (n + 1)) - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    return j.select(*keys, n.cast("long").alias("n"), "k", h.alias("h"), ((h - F.col("k") + 1) / (n - F.col("k"))).alias("eta2"))


def mann_whitney(df: DataFrame, value: str, label: str, a, b, *keys: str) -> DataFrame:
    """(keys, na, nb, u, z): U of group a against b, and its normal deviate with tie and continuity correction.

    Without keys always one row. A group without rows counts 0; u is NULL without group a, z wherever all rows tie or a group is missing.
    """
    n_of = lambda v: F.count(F.when(F.col(label) == v, 1)).cast("double")
    d = df.filter(F.col(value).isNotNull() & F.col(label).isin(a, b)).groupBy(*keys, value).agg(F.count("*").alias("t"), n_of(a).alias("ca"), n_of(b).alias("cb"))
    t, d = F.col("t").cast("double"), staged(d, "values")
    g = pooled_ranks(d, value, *keys).groupBy(*keys).agg(*(F.coalesce(F.sum(f"c{s}"), F.lit(0.0)).alias(f"n{s}") for s in ("a", "b")), F.sum(F.col("r") * F.col("ca")).alias("ra"), F.sum(t * (t * t - 1)).alias("ties"))
    na, nb = F.col("na"), F.col("nb")
    n, u = na + nb, F.when(na > 0, F.col("ra") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12 * ((n + 1) - ratio(F.col("ties"), n * (n - 1))))
    z = ratio(F.abs(u - na * nb / 2) - 0.5, sd) * F.signum(u - na * nb / 2)
    return g.select(*keys, na.cast("long").alias("na"), nb.cast("long").alias("nb"), u.alias("u"), z.alias("z"))


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, spearman, pearson) over the complete pairs; for few keys over many rows (``mean_rank`` serves many small keys)."""
    d = df.dropna(subset=[x, y, *keys]).groupBy(*keys, x, y).agg(F.count("*").alias("c"))
    d = staged(d, "values")
    for v, r in ((x, "rx"), (y, "ry")):
        ranks = pooled_ranks(d.groupBy(*keys, v).agg(F.sum("c").alias("t")), v, *keys)
        d = d.join(ranks.select(*keys, v, F.col("r").alias(r)), [*keys, v])
    # a pair stands for c rows: weighted moments around the means
    c, by = F.col("c").cast("double"), list(keys)
    mean = lambda v: (F.sum(c * F.col(v)) / F.sum(c)).alias(f"_m_{v}")
    means = d.groupBy(*by).agg(F.sum("c").alias("n"), *(mean(v) for v in ("rx", "ry", x, y)))
    d = d.join(means, by) if by else d.crossJoin(F.broadcast(means))  # one row
    off = lambda v: F.col(v) - F.col(f"_m_{v}")
    both = lambda a, b: F.sum(c * off(a) * off(b))
    r = lambda a, b: ratio(both(a, b), F.sqrt(both(a, a)) * F.sqrt(both(b, b)))
    return d.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), r("rx", "ry").alias("spearman"), r(x, y).alias("pearson"))


def line_fit(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, slope, intercept, r)."""
    d = df.dropna(subset=[x, y])
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), correlation(F.col(x), F.col(y)).alias("r"))
