"""Special functions against known values, and the studies that SQL cannot repeat against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.functions import special
from alphaloom.operators import factors, information, micro, ranking, text
from alphaloom.plans import events, fullpanel, studies
from alphaloom.sources import tables
from brute_information import one_group_label


def test_tails_have_their_known_values():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_tail(5.0, 2) == pytest.approx(math.exp(-2.5), abs=1e-14)
    assert special.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10) and special.chi2_tail(0, 3) == 1
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)


def test_p_value_functions_are_columns(spark):
    d = spark.createDataFrame([(1.959963984540054, 10.0, 2.0), (None, 1.0, 2.0)], "z double, df double, k double")
    r = d.select(special.normal_cdf("z").alias("a"), special.t_pvalue("z", "df").alias("b"), special.chi2_pvalue("z", "k").alias("c")).collect()
    assert r[0]["a"] == pytest.approx(0.975, abs=1e-12) and r[0]["b"] == pytest.approx(special.t_two_sided(1.959963984540054, 10)) and r[0]["c"] == pytest.approx(math.exp(-0.979981992270027))
    assert r[1]["a"] is None and r[1]["b"] is None and r[1]["c"] is None
    assert [x[0] for x in spark.createDataFrame([(0.0001,), (0.02,), (0.2,)], "p double").select(studies.stars(F.col("p"))).collect()] == ["***", "*", ""]


def test_permutation_test(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(-1, 2, 120)
    rows = [(float(x + 0.8 * y), int(y)) for x, y in zip(rng.normal(size=120), label, strict=True)]
    r = studies.permutation_test(spark.createDataFrame(rows, "ret double, label int"), 40).first()
    s = sorted(rows)
    x, y = np.array([a for a, _ in s]), np.array([b for _, b in s])
    names, sizes = np.unique(y, return_counts=True)
    shuffled = [one_group_label(x, names[np.searchsorted(np.cumsum(sizes), information.permuted(np.arange(120), 120, k, 42), "right")]) for k in range(1, 41)]
    real = one_group_label(x, y)
    assert r["n"] == 120 and r["mi"] == pytest.approx(real, abs=1e-7) and r["shuffled_mean"] == pytest.approx(np.mean(shuffled), abs=1e-7)
    assert r["p"] == pytest.approx(np.mean([v >= real for v in shuffled])) and r["shuffled_95"] == pytest.approx(np.percentile(shuffled, 95), abs=1e-7)


def test_sections_of_a_filing(spark):
    body = "Front matter\nItem 1. \nour business\nitem 1A\nrisks one\nITEM 8.\nnumbers\n  Item 7:\nresults\nITEM 1A.\nrisks two\nsee item 7 for more"
    rows = spark.createDataFrame([(1, body), (2, None), (3, "no heading"), (4, "")], "id int, text string")
    got = {(r["id"], r["section"]): r["chunk_text"] for r in text.section_chunks(rows, "id").collect()}
    assert got == {(1, "1"): "our business", (1, "1A"): "risks one risks two see item 7 for more", (1, "7"): "results"}


def test_nonlinearity_has_a_floor(spark):
    r = spark.range(1).select(studies.nonlinearity(F.lit(0.1), F.lit(-0.5)).alias("a"), studies.nonlinearity(F.lit(0.1), F.lit(0.0)).alias("b")).first()
    assert r["a"] == pytest.approx(0.2) and r["b"] == pytest.approx(1e5)


def test_statement_labels(spark):
    import datetime as dt

    d0, d1 = dt.date(2020, 12, 31), dt.date(2021, 12, 31)
    rows = [
        ("A", d0, "Net Income", 10.0), ("A", d1, "NetIncome", 99.0), ("A", d1, "Net Income", 20.0), ("A", d0, "Common Stock Equity", 50.0), ("A", d0, "Share Issued", 5.0), ("A", d1, "Share Issued", 0.0),
        ("A", d0, "Total Assets", float("nan")), ("A", d1, "Total Assets", 100.0), ("A", d1, "Stockholders Equity", None),
        ("B", d0, "NetIncome", 4.0), ("B", d0, "Ordinary Shares Number", 2.0), ("B", d1, "Diluted EPS", 7.0), ("B", d1, "Something else", 1.0),
    ]
    got = {(r["ticker"], r["known"]): (r["eps"], r["bvps"], r["roe"], r["roa"]) for r in factors.statement_ratios(spark.createDataFrame(rows, "ticker string, fiscal_date date, label string, value double")).collect()}
    k0, k1 = d0 + dt.timedelta(60), d1 + dt.timedelta(60)
    # a ticker that reports earnings per share has no others; equity by its second name, as the first has no value
    assert got == {("A", k0): (2.0, 10.0, 0.2, None), ("A", k1): (None, None, None, 0.2), ("B", k1): (7.0, None, None, None)}


def test_second_model_labels_days(spark):
    import datetime as dt

    rng = np.random.default_rng(1)
    rows = []
    for i in range(59):
        kind = (0, 0, 1, -1)[i % 4]
        rows.append((dt.date(2021, 1, 1) + dt.timedelta(i), "T", float(rng.poisson(20 + 40 * (kind == 1))), float(rng.poisson(20 + 40 * (kind == -1)))))
    out = micro.vdj_factor(spark.createDataFrame(rows, "date date, ticker string, dbuys double, dsells double"), "both").collect()
    assert {r["period"] for r in out} == {"annual", "monthly"} and len(out) == 118
    year = {r["date"]: r["event_label"] for r in out if r["period"] == "annual"}
    assert np.mean([year[d] == (0, 0, 1, -1)[i % 4] for i, (d, *_) in enumerate(rows)]) > 0.9


def test_smoother_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(information, "BLOCK", 37)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 60, 300).astype(float), rng.normal(size=300)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0), (901, 1.0, None)], "i int, x double, y double")
    order = sorted(range(300), key=lambda i: (x[i], i))
    for window, w in ((40, 40), (None, 30)):
        got = {r["row_no"]: (r["x"], r["y"]) for r in ranking.smoothed(d, "x", "y", window, 5, "i").collect()}
        assert set(got) == set(range(1, 300 - w + 2, 5))
        assert all(got[r] == pytest.approx((x[order[r - 1 : r - 1 + w]].mean(), y[order[r - 1 : r - 1 + w]].mean()), abs=1e-9) for r in got)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as Some

    from alphaloom.session import scratch_root

    uri = Some(toString=lambda: "file:///")
    jvm = Some(org=Some(apache=Some(hadoop=Some(fs=Some(FileSystem=Some(getDefaultUri=lambda conf: uri))))))
    sc = lambda master: Some(master=master, applicationId="app-1", getConf=lambda: Some(get=lambda *a: None), getCheckpointDir=lambda: None, _jvm=jvm, _jsc=Some(hadoopConfiguration=lambda: None))
    session = lambda master: Some(sparkContext=sc(master), conf=Some(get=lambda *a: None))
    assert scratch_root(session("local[4]")) == "file:/tmp/alphaloom-app-1" or scratch_root(session("local[4]")).endswith("/tmp/alphaloom-app-1")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(session("spark://head:7077"))


def test_pin_and_sentiment_act_in_the_full_back_tests(spark, tiny):
    from alphaloom.plans import fullpanel, panel

    full, small = fullpanel.full_scores(spark, tiny), panel.scores(spark, tiny).withColumnRenamed("score", "small")
    both = full.join(small, ["date", "ticker"])
    assert both.count() == small.count() and both.filter("abs(score - small) > 1e-6").count() > 0
    chosen = {r["factor"] for r in fullpanel.r28(spark, "/root/testdata/sf0.01").collect()}  # the smallest tables have too few tickers a day
    assert {"pin", "news_sentiment", "filing_sentiment"} <= chosen and "event_label" not in chosen


def test_best_horizon_leaves_out_pairs_that_nothing_compares(spark):
    rows = [("T", h, v, x * h * v) for h in (1, 5) for v, x in ((1, 1.0), (1, 2.0), (-1, 1.0), (-1, 3.0), (0, 4.0))]  # one day without news
    got = studies.best_horizon(spark.createDataFrame(rows, "ticker string, horizon int, label int, ret double")).collect()
    assert [tuple(r) for r in got] == [("good_bad", 5, 17.5)]


def test_rank_tests_of_a_missing_label_have_rows(spark):
    s = spark.createDataFrame([(1, 1.0), (1, 2.0), (-1, 2.0)], "label int, ret double")
    row = lambda d, *p: tuple(events.rank_pair(d, "p", *p).first())
    assert row(s, 1, -1)[:4] == ("p", 2, 1, 0.5)
    assert row(s, 1, 0)[:4] == ("p", 2, 0, 0.0) and math.isnan(row(s, 1, 0)[4]) and row(s, 1, 0)[5] is None and math.isnan(row(s, 1, 0)[6])
    assert row(s, 0, -1) == ("p", 0, 1, None, None, None, None)
    assert row(s.limit(0), 1, -1) == ("p", 0, 0, None, None, None, None)


def test_trades_are_aggregated_once_for_all_branches(spark, tiny, monkeypatch):
    made = []
    read = tables.read
    monkeypatch.setattr(tables, "read", lambda s, d, name: made.append(name) or read(s, d, name))
    assert all(q.__wrapped__ for q in (fullpanel.a07, fullpanel.b04, fullpanel.b05))
    z = tables.read_once(lambda s, d: fullpanel.studies.panel.z_panel(s, d).join(tables.bars(s, d).select("date", "ticker", "volume"), ["date", "ticker"]))(spark, tiny)
    assert made.count("lineitem") == 2  # bars and statements
    assert z.count() > 0 and not any("lineitem" in f for f in z.inputFiles())
    assert any("lineitem" in f for f in tables.bars(spark, tiny).inputFiles())  # outside nothing is held
