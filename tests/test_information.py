"""Mutual information over blocks against one-group estimates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import information
from brute_information import one_group, one_group_label


def noisy(spark, rows, schema, keys, columns):
    """The scaled sample with the operator's own noise."""
    return information.scaled(spark.createDataFrame(rows, schema), keys, columns, ["id"]).toPandas()


def sample(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in (("linear", 700), ("heavy", 500), ("steps", 400), ("few", 30)):
        x = rng.standard_normal(n) if key != "heavy" else rng.standard_cauchy(n)
        y = x + 0.5 * rng.standard_normal(n) if key != "steps" else np.round(x)
        rows += [(key, f"{key}{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return rows + [("linear", "null", None, 1.0)]


@pytest.mark.parametrize("block", [40, 50_000])
def test_continuous_equals_one_group(spark, block):
    rows, schema = sample(), "key string, id string, x double, y double"
    got = {r["key"]: (r["mi"], r["n"]) for r in information.continuous(spark.createDataFrame(rows, schema), ["key"], "x", "y", ["id"], block=block).collect()}
    want = {k: one_group(g["x"].to_numpy(), g["y"].to_numpy()) for k, g in noisy(spark, rows[:-1], schema, ["key"], ["x", "y"]).groupby("key")}
    assert got["few"] == (None, 30)
    for k in ("linear", "heavy", "steps"):
        assert got[k][0] == pytest.approx(want[k], abs=1e-7)  # digamma of small counts in numpy is exact to 1e-9 each


def test_gaussian_samples(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(2000)
    rows = [(k, i, float(a), float(b)) for k, y in (("dependent", 0.8 * x + 0.6 * rng.standard_normal(2000)), ("none", rng.standard_normal(2000))) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {r["key"]: r["mi"] for r in information.continuous(spark.createDataFrame(rows, "key string, id int, x double, y double"), ["key"], "x", "y", ["id"], block=300).collect()}
    assert got["dependent"] == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.06) and got["none"] < 0.05


def test_block_is_no_larger_than_asked(spark):
    d = information.ordered(spark.range(10_000).select(F.rand(1).alias("x")), [], ["x"], "t", 500, 10_000)
    assert d.groupBy("_block").count().agg(F.max("count")).first()[0] < 1500


@pytest.mark.parametrize("block,halo", [(30, 2), (50_000, 1000)])
def test_discrete_equals_one_group(spark, block, halo):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 300), ("b", 120), ("rare", 60)):
        for i in range(n):
            x = float(rng.integers(0, 12)) if key == "b" else float(rng.standard_normal())
            lab = int(x > 0.3) + int(rng.random() < 0.2) if key != "rare" else (i < 3) + 5 * (i == 7)
            rows.append((key, f"{key}{i}", x, lab))
    schema = "key string, id string, x double, label int"
    got = {r["key"]: (r["mi"], r["n"]) for r in information.discrete(spark.createDataFrame(rows, schema), ["key"], "x", "label", ["id"], block=block, halo=halo).collect()}
    for k, g in noisy(spark, rows, schema, ["key"], ["x"]).groupby("key"):
        assert got[k] == (pytest.approx(one_group_label(g["x"].to_numpy(), g["label"].to_numpy()), abs=1e-7), len(g))


def test_rounds_shuffle_labels_and_copy_nothing(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(400)
    rows = [(f"r{i}", float(v), int(v > 0)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id string, x double, label int")
    by = {b: {r["round"]: r["mi"] for r in information.discrete(d, [], "x", "label", ["id"], rounds=60, block=b, halo=5).collect()} for b in (37, 50_000)}
    assert set(by[37]) == set(range(61))
    assert all(by[37][r] == pytest.approx(by[50_000][r], abs=1e-9) for r in by[37])
    assert by[37][0] == pytest.approx(np.log(2), abs=0.05) and max(v for r, v in by[37].items() if r) < 0.15
    # a round is a shuffle of the labels: every row gets one, each label as often as before
    for r in (1, 2):
        image = information.permuted(np.arange(400), 400, r, 42)
        assert sorted(image.tolist()) == list(range(400)) and (image != np.arange(400)).mean() > 0.9
    s = pd.Series(information.permuted(np.arange(400), 400, 1, 42)).corr(pd.Series(information.permuted(np.arange(400), 400, 2, 42)))
    assert abs(s) < 0.2


def test_empty_samples(spark):
    d = spark.createDataFrame([], "key string, id string, x double, y double, label int")
    assert information.continuous(d, ["key"], "x", "y", ["id"]).count() == 0
    assert information.discrete(d, ["key"], "x", "label", ["id"]).count() == 0


def test_ranks_of_queries(spark):
    rng = np.random.default_rng(8)
    v, q = rng.integers(0, 20, 200), rng.integers(-2, 23, 50)
    values = spark.createDataFrame([("k", float(a)) for a in v], "key string, v double")
    queries = spark.createDataFrame([("k", i, float(a), s) for i, a in enumerate(q) for s in (-1, 1)], "key string, id int, v double, side int")
    for r in information.counted(values, queries, ["key"], 30).collect():
        assert r["below"] == ((v < r["v"]).sum() if r["side"] < 0 else (v <= r["v"]).sum())
