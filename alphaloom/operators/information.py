"""Mutual information of pooled samples of any size: neighbour searches over blocks of a sorted order.

Rows are sorted once by range partitions (``ordered``), a block is a bounded stretch of that order, and what crosses a block's rim is
looked up in the blocks it reaches:

* ``continuous`` (Kraskov's estimator I1): every block finds the k nearest points among its own; a point whose k-th distance reaches
  beyond the block asks just the blocks in reach, so halos widen only where they must. Marginal counts are ranks: block counts summed up
  before the block, and a running count within it.
* ``discrete`` (Ross's estimator against a label, with permutation rounds): blocks carry a halo of ranks on both sides; blocks in which a
  neighbour may lie beyond the halo are done again with twice the halo. A round shuffles the labels by a keyed permutation of row numbers that
  every task evaluates for its own rows, so rounds copy nothing.

Noise that breaks ties comes from a hash of the rows' identity, so results do not depend on the layout of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.special import digamma
from alphaloom.session import staged

BLOCK = 50_000
MARGIN = 2.0**-50


def digamma_of(n: Column) -> Column:
    """Digamma of whole numbers from 1 on: ten steps of the recurrence, then the asymptotic series."""
    x = n.cast("double")
    y = x + 10
    f = 1 / (y * y)
    steps = sum((1 / (x + i) for i in range(1, 10)), 1 / x)
    return F.log(y) - 0.5 / y - f * (1 / F.lit(12.0) - f * (1 / F.lit(120.0) - f * (1 / F.lit(252.0) - f / 240))) - steps


def noise(ids: Sequence[str], seed: int) -> Column:
    """A standard normal value from a hash of ``ids``."""
    unit = lambda s: (F.pmod(F.xxhash64(*ids, F.lit(s)), F.lit(2**53)) + 0.5) / 2.0**53
    return F.sqrt(-2 * F.log(unit(seed))) * F.cos(2 * np.pi * unit(seed + 1))


def scaled(d: DataFrame, keys: list[str], columns: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """``columns`` of unit deviation per key with tiny noise, and ``n``, the rows of the key."""
    parts = [F.count("*").alias("n")]
    for c in columns:
        parts += [F.stddev_pop(c).alias(f"_sd_{c}"), F.avg(F.abs(c)).alias(f"_mean_{c}")]
    sums = d.groupBy(*keys).agg(*parts)
    d = d.join(sums, keys) if keys else d.crossJoin(F.broadcast(sums))  # one row
    for i, c in enumerate(columns):
        unit = F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0)
        d = d.withColumn(c, F.col(c) / unit + 1e-10 * F.greatest(F.lit(1.0), F.col(f"_mean_{c}") / unit) * noise(ids, seed + 10 * i))
    return d.drop(*(x for c in columns for x in (f"_sd_{c}", f"_mean_{c}")))


def ordered(d: DataFrame, keys: list[str], by: list[str], name: str, block: int, rows: int) -> DataFrame:
    """``d``, which has ``rows`` rows, staged in the order of ``keys`` and ``by``, in range partitions of about ``block`` rows, numbered as ``_block``."""
    parts = max(1, -(-rows // block))
    return staged(d.repartitionByRange(parts, *keys, *by).withColumn("_block", F.spark_partition_id()), name)


def before(d: DataFrame, keys: list[str], count: Column) -> DataFrame:
    """(keys, _block, _before): what ``count`` sums up to in the blocks before each block of a key; a row per key and block."""
    sizes = d.groupBy(*keys, "_block").agg(F.sum(count).alias("_n"))
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def counted(values: DataFrame, queries: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``queries`` (keys, v, side, more) with ``below``: how many ``values`` (keys, v) are less (side -1) or not greater (side 1)."""
    both = values.select(*keys, "v").withColumn("side", F.lit(0)).unionByName(queries, allowMissingColumns=True)
    d = ordered(both, keys, ["v", "side"], "rank-queries", block, values.count() + queries.count())
    one = (F.col("side") == 0).cast("long")
    running = F.sum(one).over(Window.partitionBy(*keys, "_block").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_own", running).filter("side <> 0").join(before(d, keys, one), [*keys, "_block"])
    return d.withColumn("below", F.col("_before") + F.col("_own")).drop("_before", "_own", "_block")


# --- two continuous samples ------------------------------------------------------------------------------------------


def nearest(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, reach: np.ndarray | None, k: int, step: int = 256) -> np.ndarray:
    """The k least Chebyshev distances (ascending, inf where there are fewer) of each query to the points, which are sorted by x.

    ``reach``: distances beyond which none matters; None: the queries are the points themselves, each left out for itself.
    """
    n, out = len(x), np.full((len(qx), k), np.inf)
    order = np.argsort(qx, kind="stable")
    for at in range(0, len(qx), step):
        mine, wide = order[at : at + step], int(np.sqrt(k * n)) + k
        while len(mine):
            a, b = qx[mine], qy[mine]
            if reach is None:
                i, j = max(0, int(mine.min()) - wide), min(n, int(mine.max()) + wide + 1)
            else:
                i, j = int(np.searchsorted(x, (a - reach[mine]).min(), "left")), int(np.searchsorted(x, (a + reach[mine]).max(), "right"))
            d = np.maximum(np.abs(a[:, None] - x[i:j]), np.abs(b[:, None] - y[i:j]))
            if reach is None:
                d[np.arange(len(mine)), mine - i] = np.inf
            if j - i > k:
                d = np.partition(d, k - 1, axis=1)[:, :k]
            d = np.sort(d, axis=1)[:, :k]
            out[mine, : d.shape[1]] = d
            if reach is not None:
                break
            # points whose k-th distance crosses the stretch look at a wider one
            gap = np.minimum(a - x[i - 1] if i else np.inf, x[j] - a if j < n else np.inf)
            mine, wide = mine[out[mine, -1] > gap], 4 * wide
    return out


def continuous(d: DataFrame, keys: list[str], x: str, y: str, ids: list[str], k: int = 5, least: int = 50, block: int = BLOCK) -> DataFrame:
    """(keys, mi, n) of x and y in nats, not below 0; fewer than ``least`` rows give NULL. Blocks follow the column with more values."""
    d = d.dropna(subset=[x, y]).select(*keys, *ids, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = staged(d, "information-pairs")
    rows = d.count()
    more = d.groupBy(*keys).agg((F.approx_count_distinct("y") > F.approx_count_distinct("x")).alias("_turn"))
    d = scaled(d, keys, ["x", "y"], ids)
    d = d.join(more, keys) if keys else d.crossJoin(F.broadcast(more))  # one row
    d = d.select(*keys, *ids, "n", F.when(F.col("_turn"), F.col("y")).otherwise(F.col("x")).alias("x"), F.when(F.col("_turn"), F.col("x")).otherwise(F.col("y")).alias("y"))
    points = ordered(d, keys, ["x"], "information-points", block, rows).withColumn("id", F.xxhash64(*ids) if ids else F.monotonically_increasing_id())
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    head = f"{head}, " if head else ""

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        a, b = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        near = nearest(a, b, a, b, None, k)
        edge = (a - near[:, -1] < a[0]) | (a + near[:, -1] > a[-1])
        return pdf[[*keys, "_block", "id", "x", "y"]].assign(eps=near[:, -1], near=pd.Series(list(near), pdf.index, object), edge=edge)

    # much work on few rows: a number of partitions of its own, which adaptive execution does not join to one
    spread = 4 * d.sparkSession.sparkContext.defaultParallelism
    solved = points.repartition(spread, *keys, "_block").groupBy(*keys, "_block").applyInPandas(own, f"{head}_block int, id long, x double, y double, eps double, near array<double>, edge boolean")
    solved = staged(solved, "information-own")
    # a row for each block of about ``block`` rows: the blocks that a point at a rim can reach
    spans = points.groupBy(*keys, "_block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("_block", "lo", "hi")).alias("_spans"))
    rims = solved.filter("edge").drop("edge")
    asked = rims.join(spans, keys) if keys else rims.crossJoin(F.broadcast(spans))  # one row
    reached = F.filter("_spans", lambda s: (s["_block"] != F.col("_block")) & (s["hi"] >= F.col("x") - F.col("eps")) & (s["lo"] <= F.col("x") + F.col("eps")))
    asked = asked.select(*keys, "id", "x", "y", "eps", F.explode(F.transform(reached, lambda s: s["_block"])).alias("_block"))

    def other(key: tuple, queries: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        q = [queries[c].to_numpy() for c in ("x", "y", "eps")]
        near = nearest(pdf["x"].to_numpy(), pdf["y"].to_numpy(), *q, k) if len(queries) else np.zeros((0, k))
        return queries[[*keys, "id"]].assign(near=pd.Series(list(near), queries.index, object))

    beyond = asked.groupBy(*keys, "_block").cogroup(points.select(*keys, "_block", "x", "y").groupBy(*keys, "_block")).applyInPandas(other, f"{head}id long, near array<double>")
    merged = rims.select(*keys, "id", "near").unionByName(beyond).groupBy(*keys, "id").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), k).alias("best"))
    eps = rims.join(merged, [*keys, "id"]).withColumn("eps", F.col("best")).select(*keys, "id", "x", "y", "eps")
    eps = staged(solved.filter("NOT edge").select(*keys, "id", "x", "y", "eps").unionByName(eps), "information-eps")
    # points strictly nearer than eps along each axis, the point itself included; the margin keeps the k-th neighbour out, whose place x + eps rounds to
    inside = lambda c: F.col("eps") - (F.abs(c) + F.col("eps")) * MARGIN
    axis = lambda c: F.struct(F.lit(c).alias("axis"), F.col(c).alias("v"))
    by = [*keys, "axis"]
    values = eps.select(*keys, F.explode(F.array(axis("x"), axis("y"))).alias("a")).select(*keys, "a.*")
    rim = lambda c, s: F.struct(F.lit(c).alias("axis"), (F.col(c) + s * inside(c)).alias("v"), F.lit(s).alias("side"))
    asks = eps.select(*keys, "id", F.explode(F.array(*(rim(c, s) for c in "xy" for s in (-1, 1)))).alias("a")).select(*keys, "id", "a.*")
    ranks = counted(values, asks, by, block).groupBy(*by, "id").agg(F.sum(F.col("side") * F.col("below")).alias("m"))
    sums = ranks.groupBy(*keys).agg(F.sum(digamma_of(F.col("m"))).alias("s"), (F.count("*") / 2).cast("long").alias("n"))
    mi = F.greatest(F.lit(0.0), digamma_of(F.col("n")) + digamma_of(F.lit(k)) - F.col("s") / F.col("n"))
    return sums.select(*keys, F.when(F.col("n") >= least, mi).alias("mi"), "n")


# --- a continuous sample against a label -----------------------------------------------------------------------------


def permuted(rows: np.ndarray, n: int, round_: int, seed: int) -> np.ndarray:
    """Images of row numbers under a keyed permutation of 0 .. n-1: a Feistel network on two halves, walked until it hits a row."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for i in range(6):
            h = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((round_ * 1_000_003 + seed * 7919 + i * 104_729) & (2**64 - 1))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(rows.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def label_terms(x: np.ndarray, label: np.ndarray, core: slice, sizes: np.ndarray, k: int, whole: tuple[bool, bool]) -> tuple[float, int, int]:
    """(sum of terms, points used, points whose neighbour may lie outside) of x[core]; ``label``: class numbers, ``sizes``: rows of each class."""
    total, used, open_ = 0.0, 0, 0
    inside = np.zeros(len(x), bool)
    inside[core] = True
    for c in np.unique(label[core]):
        if sizes[c] < 2:
            continue
        kk = int(min(k, sizes[c] - 1))
        at = np.flatnonzero(label == c)
        own, n = x[at], len(at)
        shifts = [np.abs(own - np.concatenate([np.full(min(max(s, 0), n), np.inf), own[max(-s, 0) : max(n - max(s, 0), 0)], np.full(min(max(-s, 0), n), np.inf)])[:n]) for s in range(-kk, kk + 1) if s]
        near = np.sort(np.stack(shifts), axis=0)[kk - 1]
        mine = inside[at]
        own, near = own[mine], near[mine]
        rim = np.minimum(np.inf if whole[0] else own - x[0], np.inf if whole[1] else x[-1] - own)
        beyond = near > rim
        open_ += int(beyond.sum())
        own, near = own[~beyond], near[~beyond]
        lo, hi = np.searchsorted(x, own - near, "right"), np.searchsorted(x, own + near, "left")
        # rounding of the sums: the bounds are the first and last points strictly nearer
        lo -= (lo > 0) & (own - x[np.maximum(lo - 1, 0)] < near)
        lo += (own - x[np.minimum(lo, len(x) - 1)] >= near) & (lo < hi)
        hi += (hi < len(x)) & (x[np.minimum(hi, len(x) - 1)] - own < near)
        hi -= (hi > lo) & (x[np.maximum(hi - 1, 0)] - own >= near)
        total += len(own) * float(digamma(np.array([kk]))[0] - digamma(np.array([sizes[c]]))[0]) - float(digamma(np.maximum(hi - lo, 1)).sum())
        used += len(own)
    return total, used, open_


def discrete(d: DataFrame, keys: list[str], x: str, label: str, ids: list[str], *, rounds: int = 0, k: int = 3, least: int = 1, block: int = BLOCK, halo: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, round, n, mi) of x and a label in nats, not below 0: round 0 as given, rounds 1 .. ``rounds`` with labels shuffled.

    ``ids`` name a row (none: rows are told apart by their place in the staged table). Fewer than ``least`` rows give NULL. A key has few
    classes: their sizes travel with each row's group.
    """
    d = d.dropna(subset=[x, label]).select(*keys, *ids, F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("label"))
    d = staged(d if ids else d.withColumn("_row", F.monotonically_increasing_id()), "labelled-rows")
    ids, rows = ids or ["_row"], d.count()
    classes = d.groupBy(*keys, "label").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_classes"))
    d = ordered(scaled(d, keys, ["x"], ids, seed), keys, ["x"], "labelled", block, rows)
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("x", *ids)) - 1
    d = d.withColumn("_place", place).join(before(d, keys, F.lit(1)), [*keys, "_block"])
    d = staged(d.select(*keys, "x", "label", "n", (F.col("_before") + F.col("_place")).alias("_rank")), "labelled-ranks")
    blocks = max(1, -(-rows // block))
    copies = max(1, min(rounds + 1, 2 * d.sparkSession.sparkContext.defaultParallelism // blocks))  # few blocks: rounds go to several tasks
    head = "".join(f"`{c}` {d.schema[c].dataType.simpleString()}, " for c in keys)

    def plan(h: int):
        def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_rank")
            part, number = int(key[-1]), int(key[-2])
            rank, v, n = pdf["_rank"].to_numpy(), pdf["x"].to_numpy(), int(pdf["n"].iloc[0])
            names = np.array([c["label"] for c in pdf["_classes"].iloc[0]])
            sizes = np.array([c["c"] for c in pdf["_classes"].iloc[0]])
            core = slice(*np.searchsorted(rank, [number * block, (number + 1) * block]))
            given, ends, rows = np.searchsorted(names, pdf["label"].to_numpy()), np.cumsum(sizes), []
            for r in range(part, rounds + 1, copies):
                own = np.searchsorted(ends, permuted(rank, n, r, seed), "right") if r else given
                rows.append((*key[:-2], number, r, n, *label_terms(v, own, core, sizes, k, (rank[0] == 0, rank[-1] == n - 1))))
            return pd.DataFrame(rows, columns=[*keys, "_b", "round", "n", "s", "used", "open"])

        first, last = F.greatest(F.col("_rank") - h, F.lit(0)), F.least(F.col("_rank") + h, F.col("n") - 1)
        spread = d.withColumn("_b", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))
        return spread, solve

    schema = f"{head}_b long, round int, n long, s double, used long, open long"
    done, left = None, None
    while True:
        spread, solve = plan(halo)
        if left is not None:
            spread = spread.join(F.broadcast(left), [*keys, "_b"], "left_semi")  # blocks, fewer than one in ``block`` rows
        spread = spread.join(classes, keys) if keys else spread.crossJoin(F.broadcast(classes))  # one row
        spread = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 1 else spread.withColumn("_part", F.lit(0))
        found = staged(spread.repartition(max(blocks, 4 * d.sparkSession.sparkContext.defaultParallelism), *keys, "_b", "_part").groupBy(*keys, "_b", "_part").applyInPandas(solve, schema), "labelled-terms")
        done = found if done is None else staged(done.join(F.broadcast(left), [*keys, "_b"], "left_anti").unionByName(found), "labelled-terms")
        left = staged(found.filter("open > 0").select(*keys, "_b").distinct(), "labelled-open")
        if left.limit(1).count() == 0:
            break
        halo *= 2
    g = done.groupBy(*keys, "round").agg(F.max("n").alias("n"), F.sum("s").alias("s"), F.sum("used").alias("u"))
    mi = F.when(F.col("u") > 0, F.greatest(F.lit(0.0), digamma_of(F.col("u")) + F.col("s") / F.col("u"))).otherwise(0.0)
    return g.select(*keys, "round", "n", F.when(F.col("n") >= least, mi).alias("mi"))
