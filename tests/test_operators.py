"""Rules that are easy to miss, on small inputs; expected values come from plain Python."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.functions import special
from alphaloom.operators import align, backtest, factors, ic, micro, ranking, stats, text

D0 = date(2000, 1, 3)
BAR = "date date, ticker string, open double, high double, low double, close double, volume double"


def bars(spark, closes, ticker="A", volumes=None):
    return spark.createDataFrame([(D0 + timedelta(i), ticker, c, c, c, c, (volumes or {}).get(i, 10.0)) for i, c in enumerate(closes)], BAR)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("date",))).collect()]


def test_missing_close_nulls_the_frame(spark):
    closes = [float(10 + i % 3) for i in range(40)]
    closes[12] = None
    z = column(factors.technical(bars(spark, closes)), "price_zscore_20d")
    assert all(v is None for v in z[:32]) and z[32] is not None
    ret = column(factors.technical(bars(spark, closes)), "ret")
    assert ret[12] is None and ret[13] is None and ret[14] is not None


def test_flat_and_rising_prices(spark):
    flat = factors.technical(bars(spark, [5.0] * 25))
    assert column(flat, "price_zscore_20d")[-1] is None and column(flat, "rsi_5d")[-1] is None and column(flat, "amihud_20d")[20] == 0
    rsi = column(factors.technical(bars(spark, [float(i + 1) for i in range(10)])), "rsi_5d")
    assert rsi[:4] == [None] * 4 and rsi[4:] == [100.0] * 6


def test_zero_volume_day_nulls_twenty_rows(spark):
    a = column(factors.technical(bars(spark, [float(5 + i % 4) for i in range(60)], volumes={30: 0.0})), "amihud_20d")
    assert all(v is None for v in a[30:50]) and a[29] is not None and a[50] is not None


def test_cross_section(spark):
    d = spark.createDataFrame([(D0, t, v, s) for t, v, s in (("A", 1.0, "x"), ("B", 1.0, "x"), ("C", 1.0, "y"), ("D", None, "y"))], "date date, ticker string, f double, sector string")
    assert column(factors.normalise(d.drop("sector"), ["f"]), "f", "ticker") == [0.0] * 4
    by_sector = factors.normalise(d.drop("sector"), ["f"], d.select("ticker", "sector"))
    assert column(by_sector, "f", "ticker") == [0.0, 0.0, None, None]
    assert factors.normalise(d.filter("ticker = 'A'"), ["f"]).first()["f"] is None


def test_asof_skips_missing_facts(spark):
    left = spark.createDataFrame([("A", D0 + timedelta(i)) for i in range(4)], "ticker string, date date")
    facts = spark.createDataFrame([("A", D0 + timedelta(1), 7.0), ("A", D0 + timedelta(2), None)], "ticker string, known date, v double")
    assert column(align.asof_backward(left, facts, "ticker", "date", "known", ["v"]), "v") == [None, 7.0, 7.0, 7.0]
    assert column(align.asof_backward(left, facts, "ticker", "date", "known", ["v"], skip_null=False), "v") == [None, 7.0, None, None]


def test_bounded_fill_counts_rows_of_the_union_grid(spark):
    days = spark.createDataFrame([(D0 + timedelta(i),) for i in (0, 1, 3, 4)], "date date")
    values = spark.createDataFrame([("A", D0, 1.0), ("B", D0 + timedelta(2), 9.0)], "ticker string, date date, v double")
    out = align.bounded_fill(values, days, 2, ["v"], lag=0).filter("ticker = 'A'")
    assert column(out, "v") == [1.0, 1.0, None, None]
    assert column(align.bounded_fill(values, days, 2, ["v"]).filter("ticker = 'A'"), "v") == [None, 1.0, 1.0, None]


def test_composite_without_weights_is_the_mean(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, 4.0)], "a double, b double")
    assert [r[0] for r in d.select(factors.composite({}, ["a", "b"])).collect()] == [1.0, 3.0]
    assert [r[0] for r in d.select(factors.composite({"a": -1, "zz": 3}, ["a", "b"])).collect()] == [-1.0, -2.0]


def test_quantile_bucket_drops_repeated_edges(spark):
    rows = [("m", float(i)) for i in range(10)] + [("k", 1.0)] * 10
    out = ranking.quantile_bucket(spark.createDataFrame(rows, "ym string, v double"), "v", "ym").collect()
    assert {r["ym"] for r in out} == {"m"} and [r["bucket"] for r in sorted(out, key=lambda r: r["v"])] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_streaks_and_buckets(spark):
    d = spark.createDataFrame([("A", D0 + timedelta(i), v) for i, v in enumerate([1, 1, 1, -1, -1, 0])], "ticker string, date date, label int")
    assert column(ranking.streaks(d, "label"), "streak") == [1, 2, 3, 1, 2, 1]
    d = spark.createDataFrame([(-0.05,), (0.05,), (0.06,), (None,)], "x double")
    assert [r[0] for r in d.select(ranking.sentiment_bucket(F.col("x"))).collect()] == ["Negative", "Neutral", "Positive", None]


def test_rank_ic_of_constants_is_null(spark):
    long = spark.createDataFrame([(D0, t, "f", 1.0) for t in "ABC"] + [(D0, t, "g", v) for t, v in zip("ABC", (1.0, 2.0, 3.0))], "date date, ticker string, factor string, value double")
    fwd = spark.createDataFrame([(D0, t, v) for t, v in zip("ABC", (0.1, 0.2, 0.3))], "date date, ticker string, fwd double")
    out = {r["factor"]: r["ic"] for r in ic.rank_ic(long, fwd).collect()}
    assert out["f"] is None and out["g"] == pytest.approx(1)


def test_rebalance_retries_after_a_failed_day(spark):
    days = spark.createDataFrame([(date(2000, 1, 31), 1), (date(2000, 2, 1), 1), (date(2000, 2, 2), 4), (date(2000, 2, 3), 9), (date(2000, 3, 1), 4)], "date date, valid int")
    assert column(backtest.rebalances(days, 2, "monthly"), "rebalance") == [False, False, True, False, True]


def test_long_short_keeps_stale_shorts(spark):
    d = [date(2000, 1, 3), date(2000, 1, 4), date(2000, 2, 1)]
    prices = [(d[i], t, float(p[i])) for t, p in {"A": (1, 1.1, 1.21), "B": (1, 1, 1), "C": (1, 1, 1), "D": (1, 0.5, 0.25)}.items() for i in range(3)]
    scores = [(x, t, float(s)) for x in d[:2] for t, s in zip("ABCD", (4, 3, 2, 1))] + [(d[2], t, float(s)) for t, s in (("A", 4), ("B", 3), ("C", 2))]
    out = backtest.long_short(spark.createDataFrame(scores, "date date, ticker string, score double"), spark.createDataFrame(prices, "date date, ticker string, close double"), 2)
    got = {(r["date"], r["leg"]): r["ret"] for r in out.collect()}
    assert got[d[1], "long"] == pytest.approx(0.05) and got[d[1], "short"] == pytest.approx(0.25) and got[d[1], "ls"] == pytest.approx(0.3)
    assert got[d[2], "short"] == pytest.approx(0.25)  # three names: only the longs were chosen anew
    assert got[d[0], "ls"] == 0


def test_performance(spark):
    d = spark.createDataFrame([(D0 + timedelta(i), r) for i, r in enumerate((0.1, -0.1, 0.0, 0.2))], "date date, ret double")
    p = backtest.performance(d.withColumn("leg", F.lit("x")), "leg").first()
    used = np.array([0.1, -0.1, 0.2])
    assert p["sharpe"] == pytest.approx(used.mean() * 252 / (used.std(ddof=1) * 252**0.5))
    assert p["max_drawdown"] == pytest.approx(-0.1) and p["annual_return"] == pytest.approx((1.1 * 0.9 * 1.2 / 1.1) ** (252 / 4) - 1)


def test_no_look_ahead(spark):
    closes = [float(10 + (i * 7) % 5) for i in range(300)]
    a = factors.technical(bars(spark, closes)).toPandas()
    b = factors.technical(bars(spark, closes[:280] + [99.0] * 20)).toPandas()
    cut = lambda d: d.sort_values("date").head(280)[factors.TECHNICAL].to_numpy()
    assert np.allclose(cut(a), cut(b), equal_nan=True)


def test_order_flow_fit_recovers_parameters():
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 250, p=[0.6, 0.24, 0.16])
    b, s = rng.poisson(150 + 60 * (kind == 1)), rng.poisson(150 + 60 * (kind == 2))
    f = micro.fit_ekop(b, s)
    assert abs(f["alpha"] - 0.4) < 0.1 and abs(f["delta"] - 0.4) < 0.15 and abs(f["mu"] - 60) < 8 and abs(f["eps"] - 150) < 4
    assert micro.fit_ekop(b[:4], s[:4]) is None and micro.fit_ekop(np.array([np.nan] * 9), s[:9]) is None


def test_mixed_poisson_density_sums_to_one():
    grid = np.array([(x, y) for x in range(60) for y in range(60)], float)
    assert np.exp(micro.log_pig(grid[:, 0], grid[:, 1], 4.0, 3.0, 2.0)).sum() == pytest.approx(1, abs=1e-3)
    assert np.exp(micro.log_pig(grid[:, 0], grid[:, 1], 4.0, 3.0, 1000.0)).sum() == pytest.approx(1, abs=1e-6)


def test_second_model_recovers_its_parameters():
    rng = np.random.default_rng(8)
    n, alpha, eps, mu, psi = 400, 0.4, 40.0, 50.0, 12.0
    kind = rng.choice(3, n, p=[1 - alpha, alpha / 2, alpha / 2])
    x = rng.wald(1.0, psi, n)
    b, s = rng.poisson(x * (eps + mu * (kind == 1))), rng.poisson(x * (eps + mu * (kind == 2)))
    f = micro.fit_vdj(b, s)
    truth = np.logaddexp.reduce(micro._vdj_parts(b.astype(float), s.astype(float), alpha, 0.5, eps, mu, psi)).sum()
    assert f["converged"] and -f["nll"] >= truth
    assert abs(f["alpha"] - alpha) < 0.08 and abs(f["delta"] - 0.5) < 0.12 and abs(f["eps"] - eps) < 5 and abs(f["mu"] - mu) < 8 and abs(math.log(f["psi"] / psi)) < 0.5
    assert f["pin"] == pytest.approx(alpha * mu / (alpha * mu + 2 * eps), abs=0.05)


def test_bessel_ratios_equal_the_recurrence():
    k = [1.0, 1.0 + 2.5]
    for t in range(3, 12):
        k.append((2 * t - 3) * k[-1] + 2.5 * 2.5 * k[-2])
    assert micro.log_bessel(11, 2.5) == pytest.approx(np.log(k), abs=1e-12)


def test_event_label_ties_go_to_good_then_bad(spark):
    d = spark.createDataFrame([(100.0, 0.0), (0.0, 100.0), (20.0, 20.0), (60.0, 60.0)], "b double, s double")
    assert [r[0] for r in d.select(micro.event_label(F.col("b"), F.col("s"), F.lit(0.5), F.lit(0.5), F.lit(20.0), F.lit(20.0))).collect()] == [1, -1, 0, 1]


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1)
    assert special.digamma(np.array([1.0, 10.0])) == pytest.approx([-0.5772156649, 2.2517525891], abs=1e-8)


def test_rank_tests(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (0, 3.0), (0, 4.0), (-1, 2.0), (-1, 5.0)], "label int, x double")
    u = stats.mann_whitney(d, "x", "label", 1, -1).first()
    assert u["u"] == 1.0 and u["z"] < 0
    assert stats.kruskal(d, "x", "label").first()["h"] == pytest.approx(3.178571 / (1 - 24 / 336), abs=1e-4)


@pytest.mark.parametrize("blocks", [2, 64])
def test_pooled_ranks_equal_ranks_in_one_sort(spark, blocks):
    rng = np.random.default_rng(3)
    # half of the rows carry one value
    rows = pd.DataFrame({"g": rng.integers(0, 2, 3000), "x": np.where(rng.random(3000) < 0.5, 7.0, rng.integers(-300, 300, 3000) / 4)})
    c = spark.createDataFrame(rows).groupBy("g", "x").agg(F.count("*").alias("t"))
    got = {(r["g"], r["x"]): r["r"] for r in ranking.pooled_ranks(c, "x", "g", blocks=blocks).collect()}
    want = rows.groupby("g")["x"].rank()
    assert all(got[(g, x)] == r for g, x, r in zip(rows["g"], rows["x"], want, strict=True))
    whole = spark.createDataFrame(rows).groupBy("x").agg(F.count("*").alias("t"))
    got = {r["x"]: r["r"] for r in ranking.pooled_ranks(whole, "x", blocks=blocks).collect()}
    assert all(got[x] == r for x, r in zip(rows["x"], rows["x"].rank(), strict=True))
    one = spark.createDataFrame(rows.assign(y=rng.random(3000))).withColumn("y", F.col("y") + F.col("x"))
    assert stats.spearman(one, "x", "y").first()["spearman"] == pytest.approx(one.toPandas()[["x", "y"]].rank().corr().iloc[0, 1], abs=1e-9)
    assert stats.spearman(one.filter("false"), "x", "y").first()["n"] == 0


def test_chunks_and_similarity(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, None), (3, " \n "), (4, "a b")], "id int, text string")
    got = [(r["id"], r["chunk"], r["chunk_text"]) for r in text.chunks(d, "id", size=4, overlap=1).orderBy("id", "chunk").collect()]
    assert got == [(1, 0, "0 1 2 3"), (1, 1, "3 4 5 6"), (1, 2, "6 7 8 9"), (4, 0, "a b")]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, q array<double>")
    assert [r["vec_id"] for r in text.cosine_top_k(v, q, 3).orderBy("pos").collect()] == [1, 3, 2]
    many = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 1.0]), (7, [1.0, 1.0])], "query_id int, q array<double>")
    found = [sorted(map(tuple, text.cosine_top_k(v, many, 2, limit=n).collect())) for n in (10, 1)]
    assert found[0] == found[1] and len(found[0]) == 6


def test_lexicon_and_model_scores(spark):
    d = spark.createDataFrame([(1, "Strong growth, weak start"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: (r["positive"], r["negative"], r["compound"]) for r in text.lexicon_scores(d, "t").collect()}
    assert got[1] == (0.5, 0.25, 0.25) and got[2] == got[3] == (None, None, None)
    terms = spark.createDataFrame([("strong", 2.0), ("growth", 1.0), ("weak", -0.5)], "term string, weight double")
    got = {r["id"]: (r["positive"], r["negative"], r["compound"], r["n_words"]) for r in text.term_scores(d, "id", "t", terms).collect()}
    assert got[1] == (0.75, 0.125, 0.625, 4) and got[2] == got[3] == (None, None, None, 0)

    def load():
        return lambda texts: [(0.75, 0.25, 0.0) if "growth" in x else (0.0, 0.0, 1.0) for x in texts]

    got = {r["id"]: (r["positive"], r["neutral"], r["compound"]) for r in text.model_scores(d, "t", load).collect()}
    assert got == {1: (0.75, 0.0, 0.5), 2: (0.0, 1.0, 0.0), 3: (0.0, 1.0, 0.0)}
