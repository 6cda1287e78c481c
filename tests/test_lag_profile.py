"""Lag profile on the common date grid against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from alphaloom.plans import events
from brute_information import one_group_label


def test_lags_follow_the_common_dates(spark):
    rng, start = np.random.default_rng(2), dt.date(2001, 1, 1)
    # B lacks every third date, so some lags have fewer than 50 pairs
    rows = [(start + dt.timedelta(i), t, int(rng.integers(-1, 2)), float(rng.normal())) for i in range(40) for t in "AB" if t == "A" or i % 3]
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "label", "ret"])
    ret, label = (pdf.pivot(index="date", columns="ticker", values=c) for c in ("ret", "label"))
    got = {r["lag"]: r for r in events.lag_profile(spark.createDataFrame(rows, "date date, ticker string, label int, ret double")).collect()}
    assert sorted(map(int, got)) == list(range(-5, 6))
    sizes = set()
    for k in range(-5, 6):
        both = pd.DataFrame({"ret": ret.stack(), "label": label.shift(-k).stack()}).dropna().sort_values(["ret", "label"])
        r = got[str(k)]
        assert r["n"] == len(both)
        sizes.add(len(both) >= 50)
        if len(both) < 50:
            assert r["spearman"] is None and r["pearson"] is None and r["mi"] is None
            continue
        ranks = both.rank()
        assert r["spearman"] == pytest.approx(ranks.ret.corr(ranks.label), abs=1e-9)
        assert r["pearson"] == pytest.approx(both.ret.corr(both.label), abs=1e-9)
        assert r["mi"] == pytest.approx(one_group_label(both.ret.to_numpy(), both.label.to_numpy().astype(float)), abs=1e-9)
    assert sizes == {True, False}
