"""Order-flow mixture models: probability of informed trading and daily event labels.

Fits run in Arrow groups, a (ticker, window) each: at most a year of days. Labels are native expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Starting points (alpha, delta, share of the mean that is informed): quarters of alpha with balanced news, the rarer the news the
#: stronger; then one-sided news, a quarter to either side.
STARTS = ((0.25, 0.5, 0.75), (0.5, 0.5, 0.5), (0.75, 0.5, 0.25), (0.25, 0.25, 0.75), (0.25, 0.75, 0.75))
LEAST_DAYS = 5


def log_poisson(k: np.ndarray, rate: float) -> np.ndarray:
    """k ln(rate) - rate - ln k!; rate 0 is allowed."""
    return k * np.log(rate + 1e-300) - rate - np.array([math.lgamma(v + 1) for v in np.atleast_1d(k)])


def _parts(b: np.ndarray, s: np.ndarray, alpha: float, delta: float, mu: float, eps: float) -> np.ndarray:
    """Log weights of a day without news, with good and with bad news; the common factorials are left out."""
    le, lm = math.log(eps), math.log(mu + eps)
    base = -2 * eps
    return np.stack([math.log(1 - alpha) + (b + s) * le + base, math.log(alpha * (1 - delta)) + b * lm + s * le + base - mu, math.log(alpha * delta) + b * le + s * lm + base - mu])


def fit_ekop(b: np.ndarray, s: np.ndarray, tolerance: float = 1e-9, steps: int = 500) -> dict | None:
    """Maximum likelihood by EM with closed-form steps from every start; the best likelihood wins."""
    b, s = np.asarray(b, float), np.asarray(s, float)
    if len(b) < LEAST_DAYS or not (np.isfinite(b).all() and np.isfinite(s).all()):
        return None
    best, mean = None, max(float((b + s).mean()) / 2, 1e-6)
    for alpha, delta, share in STARTS:
        mu, eps, last = max(mean * share, 1e-6), max(mean * (1 - 0.4 * share), 1e-6), -np.inf
        for _ in range(steps):
            w = _parts(b, s, alpha, delta, mu, eps)
            top = w.max(axis=0)
            like = top + np.log(np.exp(w - top).sum(axis=0))
            r0, rg, rb = np.exp(w - like)
            total, news = float(like.sum()), float((rg + rb).sum())
            alpha, delta = min(max(news / len(b), 1e-6), 1 - 1e-6), min(max(float(rb.sum()) / news if news > 0 else delta, 1e-6), 1 - 1e-6)
            if news > 1e-12:
                rate = float((rg * b + rb * s).sum()) / news
                eps = max(float((r0 * (b + s) + rg * s + rb * b).sum()) / (2 * float(r0.sum()) + news), 1e-6)
                if rate < eps:
                    rate = eps = mean
                mu = max(rate - eps, 1e-6)
            if total - last <= tolerance * (1 + abs(total)):
                break
            last = total
        if best is None or total > best["loglik"] + 1e-9 * (1 + abs(total)):
            best = {"alpha": alpha, "delta": delta, "mu": mu, "eps": eps, "pin": alpha * mu / (alpha * mu + 2 * eps), "loglik": total}
    return best


FIT = "alpha double, delta double, mu double, eps double, pin double, loglik double"


def ekop_parameters(flow: DataFrame, window: Column) -> DataFrame:
    """(ticker, window, alpha .. loglik) of every ticker and window with LEAST_DAYS days at least."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        fit = fit_ekop(pdf["buys"].to_numpy(), pdf["sells"].to_numpy())
        return pd.DataFrame([{"ticker": pdf["ticker"].iloc[0], "window": pdf["window"].iloc[0], **fit}] if fit else [], columns=["ticker", "window", *(c.split()[0] for c in FIT.split(", "))])

    d = flow.dropna(subset=["buys", "sells"]).select("ticker", window.cast("string").alias("window"), "date", "buys", "sells")
    return d.groupBy("ticker", "window").applyInPandas(run, f"ticker string, window string, {FIT}")


def event_label(b: Column, s: Column, alpha: Column, delta: Column, mu: Column, eps: Column) -> Column:
    """1 good news, -1 bad news, 0 none: the largest posterior, ties in this order. Factorials and common terms cancel."""
    lift = F.log(1 + mu / eps)
    good = F.log(alpha * (1 - delta) / (1 - alpha)) + b * lift - mu
    bad = F.log(alpha * delta / (1 - alpha)) + s * lift - mu
    return F.when((good >= bad) & (good >= 0), 1).when(bad >= 0, -1).otherwise(0)


def ekop_factor(flow: DataFrame, period: str = "annual") -> DataFrame:
    """(date, ticker, period, pin, event_label); ``period``: annual, monthly or both."""
    kinds = {"annual": F.date_format("date", "yyyy"), "monthly": F.date_format("date", "yyyy-MM")}
    out = None
    for kind in kinds if period == "both" else [period]:
        p = ekop_parameters(flow, kinds[kind])
        d = flow.withColumn("window", kinds[kind]).join(p, ["ticker", "window"])
        label = event_label(*(F.col(c) for c in ("buys", "sells", "alpha", "delta", "mu", "eps")))
        d = d.select("date", "ticker", F.lit(kind).alias("period"), "pin", label.alias("event_label"))
        out = d if out is None else out.unionAll(d)
    return out


# --- the same with gamma-like (inverse-Gaussian) mixing of the intensities -------------------------------------------

POISSON_PSI, POISSON_TRADES = 100.0, 1000


def log_bessel(most: int, z: float) -> np.ndarray:
    """ln of the scaled half-integer Bessel functions for t = 1 .. most (at least 2), from the ratios of neighbouring orders."""
    ratios = [1.0, 1.0 + z]
    for t in range(3, most + 1):
        ratios.append(2 * t - 3 + z * z / ratios[-1])
    return np.cumsum(np.log(ratios))


def log_factorials(b: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x + 1) + math.lgamma(y + 1) for x, y in zip(b, s, strict=True)])


def log_pig(b: np.ndarray, s: np.ndarray, l1: float, l2: float, psi: float, fact: np.ndarray | None = None) -> np.ndarray:
    """Log density of counts whose two Poisson rates share an inverse-Gaussian factor of mean 1 and shape psi.

    ``fact`` spares a fit the factorials of its days.
    """
    t = (b + s).astype(int)
    if psi > POISSON_PSI or t.max(initial=0) > POISSON_TRADES:
        return log_poisson(b, l1) + log_poisson(s, l2)
    # E[x**t exp(-x L)] of the factor x, with omega = sqrt(psi (psi + 2 L)): Bessel functions of order t - 1/2
    omega = math.sqrt(psi * (psi + 2 * (l1 + l2)))
    k = np.concatenate([[0.0], log_bessel(int(t.max(initial=0)), omega)])
    lk = np.where(t > 0, k[np.minimum(t, len(k) - 1)] + t * math.log(psi) - (2 * t - 1) * math.log(omega), 0.0)
    fact = log_factorials(b, s) if fact is None else fact
    return b * math.log(l1 + 1e-300) + s * math.log(l2 + 1e-300) - fact + psi - omega + lk


def _vdj_parts(b, s, alpha, delta, eps, mu, psi, fact=None):
    states = ((1 - alpha, 0, 0), (alpha * (1 - delta), mu, 0), (alpha * delta, 0, mu))
    return np.stack([math.log(share) + log_pig(b, s, eps + up, eps + down, psi, fact) for share, up, down in states])


def nelder_mead(f, x: np.ndarray, step: float = 0.4, steps: int = 1000, tolerance: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Minimum of f by the downhill simplex: the point, the value, and whether the values met ``tolerance`` within ``steps``."""
    n = len(x)
    pts = [np.array(x, float)] + [np.array(x, float) + step * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    met = False
    for _ in range(steps):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        met = abs(val[-1] - val[0]) <= tolerance * (1 + abs(val[0]))
        if met:
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], val[i], bool(met)


#: Logits of alpha and delta, logs of eps and mu over half the mean trades, log of psi: few and many informed days, even and
#: one-sided news, weak and strong day-to-day scatter.
VDJ_STARTS = ((-0.8, 0.0, -0.3, -0.5, 1.5), (0.0, 0.0, -0.1, 0.0, 3.0), (-2.0, 0.0, -0.1, 0.7, 0.5), (-0.4, 1.2, -0.3, 0.2, 2.5), (-0.4, -1.2, -0.3, 0.2, 2.5))


def fit_vdj(b: np.ndarray, s: np.ndarray) -> dict | None:
    """Maximum likelihood over logit and log parameters; labels from the posteriors in logs.

    Five starts run to a coarse tolerance, the best of them to a fine one, from a new simplex; ``converged`` tells whether it got there.
    """
    b, s = np.asarray(b, float), np.asarray(s, float)
    if len(b) < LEAST_DAYS or not (np.isfinite(b).all() and np.isfinite(s).all()):
        return None
    m = max(float((b + s).mean()) / 2, 1e-3)
    unlogit = lambda v: 1e-6 + (1 - 2e-6) / (1 + math.exp(-min(max(v, -30), 30)))

    def params(v):
        return unlogit(v[0]), unlogit(v[1]), m * math.exp(min(v[2], 3.0)), m * math.exp(min(v[3], 3.0)), math.exp(min(max(v[4], -4.6), 10.0))

    def loss(v):
        w = _vdj_parts(b, s, *params(v), fact)
        top = w.max(axis=0)
        return -float((top + np.log(np.exp(w - top).sum(axis=0))).sum())

    fact = log_factorials(b, s)
    best = min((nelder_mead(loss, np.array(x), tolerance=1e-5) for x in VDJ_STARTS), key=lambda r: r[1])
    best = nelder_mead(loss, best[0], step=0.1)
    alpha, delta, eps, mu, psi = params(best[0])
    none, good, bad = _vdj_parts(b, s, alpha, delta, eps, mu, psi, fact)
    label = np.where((good >= bad) & (good >= none), 1, np.where(bad >= none, -1, 0))
    pin = min(max(alpha * mu / (alpha * mu + 2 * eps), 0.0), 1.0)
    return {"alpha": alpha, "delta": delta, "mu": mu, "eps": eps, "psi": psi, "pin": pin, "nll": best[1], "converged": best[2], "good": int((label == 1).sum()), "bad": int((label == -1).sum()), "none_": int((label == 0).sum()), "pin_empirical": float((label != 0).mean())}


VDJ = "symbol string, window string, alpha double, delta double, mu double, eps double, psi double, pin double, nll double, converged boolean, good int, bad int, none_ int, pin_empirical double"


def vdj_parameters(counts: DataFrame, window: Column, least_days: int = 15, least_mean: float = 50.0) -> DataFrame:
    """Fits of every symbol and window with enough days and trades (a group is a month or a symbol's days)."""
    names = [c.split()[0] for c in VDJ.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        fit = fit_vdj(pdf["dbuys"].to_numpy(), pdf["dsells"].to_numpy())
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "window": pdf["window"].iloc[0], **fit}] if fit else [], columns=names)

    d = counts.dropna(subset=["dbuys", "dsells"]).select("symbol", window.cast("string").alias("window"), "date", "dbuys", "dsells")
    ok = d.groupBy("symbol", "window").agg(F.count("*").alias("n"), F.avg(F.col("dbuys") + F.col("dsells")).alias("m")).filter((F.col("n") >= least_days) & (F.col("m") >= least_mean))
    d = d.join(ok.select("symbol", "window"), ["symbol", "window"], "left_semi")
    # a fit is much work on few rows: a number of partitions of its own, which adaptive execution does not join to one
    spread = 4 * counts.sparkSession.sparkContext.defaultParallelism
    return d.repartition(spread, "symbol", "window").groupBy("symbol", "window").applyInPandas(run, VDJ)


def vdj_factor(flow: DataFrame, period: str = "annual", least_mean: float = 1.0) -> DataFrame:
    """(date, ticker, period, pin, event_label) of the second model on the days of ``flow`` (date, ticker, dbuys, dsells).

    ``period``: annual, monthly or both. Days are labelled by the largest posterior in logs under their window's fit, ties good, bad, none.
    """
    kinds = {"annual": F.date_format("date", "yyyy"), "monthly": F.date_format("date", "yyyy-MM")}
    schema = "date date, ticker string, period string, pin double, event_label int"
    out = None

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        none, good, bad = _vdj_parts(pdf["dbuys"].to_numpy(float), pdf["dsells"].to_numpy(float), r["alpha"], r["delta"], r["eps"], r["mu"], r["psi"])
        pdf["event_label"] = np.where((good >= bad) & (good >= none), 1, np.where(bad >= none, -1, 0)).astype("int32")
        return pdf[["date", "ticker", "period", "pin", "event_label"]]

    for kind in kinds if period == "both" else [period]:
        p = vdj_parameters(flow.withColumnRenamed("ticker", "symbol"), kinds[kind], LEAST_DAYS, least_mean).withColumnRenamed("symbol", "ticker").drop("converged", "good", "bad", "none_", "pin_empirical", "nll")
        d = flow.dropna(subset=["dbuys", "dsells"]).withColumn("window", kinds[kind]).join(p, ["ticker", "window"]).withColumn("period", F.lit(kind))
        d = d.groupBy("ticker", "window").applyInPandas(label, schema)  # a window's days, a year at most
        out = d if out is None else out.unionAll(d)
    return out


def qualified(counts: DataFrame, least_days: int = 15, least_mean: float = 50.0, least_months: int = 24) -> DataFrame:
    """(symbol, months): symbols with enough months of enough days and trades."""
    m = counts.groupBy("symbol", F.trunc("date", "MM").alias("ym")).agg(F.count("*").alias("n"), F.avg(F.col("dbuys") + F.col("dsells")).alias("m"))
    m = m.filter((F.col("n") >= least_days) & (F.col("m") >= least_mean))
    return m.groupBy("symbol").agg(F.count("*").alias("months")).filter(F.col("months") >= least_months)
