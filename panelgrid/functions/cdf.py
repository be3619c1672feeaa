"""Distribution functions in plain Python.

The SQL twins take critical values from here and tests hold the column expressions of
``distributions`` against them; no query calls them.
"""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """Upper regularized incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    # Lentz continued fraction
    b = x + 1 - a
    c = 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def beta_reg(a, b, x):
    """Regularized incomplete beta function, vectorised over ``x`` (and ``a``)."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    lgam = np.vectorize(math.lgamma, otypes=[float])
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgam(p + q) - lgam(p) - lgam(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(y)
    d = 1.0 / (1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        num = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 / (1 + num * d)
        c = 1 + num / c
        h = h * c * d
        num = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 / (1 + num * d)
        c = 1 + num / c
        step = c * d
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    out = np.where((y <= 0), 0.0, front * h)
    return np.where(flip, 1 - out, out)


def student_two_sided(t, df):
    """P(|T| > t) for Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_reg(df / 2, 0.5, df / (df + t * t))


def normal_critical(alpha: float = 0.05) -> float:
    """Two-sided critical value of the normal distribution, by bisection."""
    lo, hi = 0.0, 40.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 2 * (1 - normal_cdf(mid)) > alpha else (lo, mid)
    return (lo + hi) / 2


def student_critical(dof, alpha: float = 0.05):
    """Two-sided critical values of Student's t for an array of degrees of freedom, by bisection."""
    dof = np.asarray(dof, dtype=float)
    lo, hi = np.zeros_like(dof), np.full_like(dof, 1e6)
    for _ in range(80):
        mid = (lo + hi) / 2
        above = student_two_sided(mid, dof) > alpha
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def signed_rank_lower_tail(n: int, w: float) -> float:
    """Exact P(W+ <= w) of the signed-rank statistic for n untied differences."""
    counts = np.ones(1)
    for r in range(1, n + 1):
        grown = np.zeros(len(counts) + r)
        grown[: len(counts)] += counts
        grown[r:] += counts
        counts = grown
    upto = int(math.floor(w))
    if upto < 0:
        return 0.0
    return float(counts[: upto + 1].sum() / counts.sum())
