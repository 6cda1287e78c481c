"""One-group estimates of mutual information, quadratic in the rows."""

import numpy as np

from alphaloom.functions.special import digamma


def one_group(x, y, k=5):
    n = len(x)
    eps = np.empty(n)
    for i in range(n):
        d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
        d[i] = np.inf
        eps[i] = np.partition(d, k - 1)[k - 1]
    inside = lambda v: np.array([(np.abs(v - v[i]) < eps[i]).sum() for i in range(n)])
    psi = lambda v: digamma(np.atleast_1d(np.asarray(v, float)))
    return max(0.0, float(psi(n)[0] + psi(k)[0] - (psi(inside(x)) + psi(inside(y))).mean()))


def one_group_label(x, label, k=3):
    terms, used = [], 0
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        if len(own) < 2:
            continue
        kk = min(k, len(own) - 1)
        for i in own:
            d = np.sort(np.abs(x[own] - x[i]))[kk]
            terms.append(digamma(np.array([kk]))[0] - digamma(np.array([len(own)]))[0] - digamma(np.array([max((np.abs(x - x[i]) < d).sum(), 1)]))[0])
        used += len(own)
    return max(0.0, float(digamma(np.array([used]))[0] + np.mean(terms)))
