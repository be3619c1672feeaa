"""Distribution functions as column expressions, for p-values inside the JVM.

Continued fractions, series and quadratures are folds over fixed arrays of steps or nodes, so a p-value
can be computed for every cell of a map without leaving the plan. Arguments are doubles; NULL gives NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelgrid.functions.columns import ColumnLike, col

STEPS = 200  # of a series or continued fraction; enough for shapes of tens of thousands
HALVINGS = 60  # of an interval that holds a quantile


def _d(x: float) -> Column:
    return F.lit(float(x))


def _double(c: ColumnLike | float) -> Column:
    return _d(c) if isinstance(c, (int, float)) else col(c).cast("double")


def let(body: Callable[[Column], Column], **fields: Column) -> Column:
    """``body`` of a struct whose fields are computed once, however often the body names them."""
    one = F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return F.get(F.transform(one, body), F.lit(0))


def fold(steps: int, start: Mapping[str, Column],
         step: Callable[[Column, Column], Mapping[str, Column]], out: str) -> Column:
    """Repeats ``step(state, m)`` for m = 1 .. ``steps`` and returns one field of the state.

    Parameters go into the state, so they are computed once and not in every step.
    """
    def packed(fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), packed(start),
                       lambda s, m: packed(step(s, m.cast("double"))), lambda s: s[out])


def log_gamma(x: ColumnLike) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series, eight further on."""
    def stirling(s):
        x, z, power = s["x"], s["x"] + 8, 1 / (s["x"] + 8)
        product, series = x, _d(0)
        for i in range(1, 8):
            product = product * (x + i)
        # Bernoulli numbers over 2k (2k - 1)
        for c in (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156):
            series, power = series + power * c, power / (z * z)
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)

    return let(stirling, x=_double(x))


def gamma_upper(a: ColumnLike, x: ColumnLike) -> Column:
    """Regularized upper incomplete gamma function Q(a, x)."""
    def lentz(s, m):
        an = m * (s["a"] - m)
        d = 1 / (an * s["d"] + s["b"] + 2)
        c = s["b"] + 2 + an / s["c"]
        return {"a": s["a"], "b": s["b"] + 2, "c": c, "d": d, "h": s["h"] * c * d}

    def body(g):
        a, x = g["a"], g["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        series = fold(STEPS, {"k": a, "x": x, "term": 1 / a, "total": 1 / a}, lambda s, m: {
            "k": s["k"] + 1, "x": s["x"], "term": s["term"] * s["x"] / (s["k"] + 1),
            "total": s["total"] + s["term"] * s["x"] / (s["k"] + 1)}, "total")
        first = 1 / (x + 1 - a)
        fraction = fold(STEPS, {"a": a, "b": x + 1 - a, "c": _d(1e300), "d": first, "h": first}, lentz, "h")
        return (F.when(x <= 0, _d(1)).when(x == float("inf"), _d(0))
                .when(x < a + 1, 1 - series * front).otherwise(fraction * front))

    return let(body, a=_double(a), x=_double(x))


def beta_lower(a: ColumnLike, b: ColumnLike, x: ColumnLike, rest: ColumnLike | None = None) -> Column:
    """Regularized incomplete beta function I_x(a, b); ``rest`` is 1 - x where it is known better."""
    def lentz(s, m):
        p, q, u, ends = s["p"], s["q"], s["u"], s["p"] + 2 * m
        one = m * (q - m) * u / ((ends - 1) * ends)
        two = -(p + m) * (p + q + m) * u / (ends * (ends + 1))
        d1, c1 = 1 / (1 + one * s["d"]), 1 + one / s["c"]
        d, c = 1 / (1 + two * d1), 1 + two / c1
        return {"p": p, "q": q, "u": u, "c": c, "d": d, "h": s["h"] * c1 * d1 * c * d}

    def fraction(g):
        p, q, u, v = g["p"], g["q"], g["u"], g["v"]
        first = 1 / (1 - (p + q) * u / (p + 1))
        h = fold(STEPS, {"p": p, "q": q, "u": u, "c": _d(1), "d": first, "h": first}, lentz, "h")
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(u) + q * F.log(v)) / p
        part = F.when(u <= 0, _d(0)).otherwise(front * h)
        return F.when(g["low"], part).otherwise(1 - part)

    def sided(g):
        # the fraction converges fast on one side of the mean
        low = g["x"] <= (g["a"] + 1) / (g["a"] + g["b"] + 2)
        return let(fraction, low=low, **{n: F.when(low, g[one]).otherwise(g[other]) for n, one, other in (
            ("p", "a", "b"), ("q", "b", "a"), ("u", "x", "y"), ("v", "y", "x"))})

    x = _double(x)
    return let(sided, a=_double(a), b=_double(b), x=x, y=1 - x if rest is None else _double(rest))


def normal_lower(z: ColumnLike) -> Column:
    """P(Z <= z) of the standard normal distribution."""
    z = _double(z)
    tail = gamma_upper(_d(0.5), z * z / 2) / 2
    return F.when(z <= 0, tail).otherwise(1 - tail)


def chi2_upper(x: ColumnLike, dof: ColumnLike) -> Column:
    """P(X > x) of the chi-squared distribution; NULL without degrees of freedom."""
    dof = _double(dof)
    return F.when(dof > 0, gamma_upper(dof / 2, _double(x) / 2))


def student_two_sided(t: ColumnLike, dof: ColumnLike) -> Column:
    """P(|T| > \\|t\\|) of Student's t; an infinite t gives 0; NULL without degrees of freedom."""
    t, dof = _double(t), _double(dof)
    # beyond 1e150 the square would overflow, and p is 0 in any case
    square = F.pow(F.least(F.abs(t), _d(1e150)), _d(2))
    p = beta_lower(dof / 2, _d(0.5), dof / (dof + square), square / (dof + square))
    return F.when((dof > 0) & t.isNotNull(), p)


def signed_rank_lower(n: ColumnLike, w: ColumnLike) -> Column:
    """Exact P(W <= w) of the signed-rank sum of ``n`` untied differences.

    Ways to reach each sum: with rank r, a sum is reached as before or from r below. Meant for n up to
    about 60, as there are 2**n ways.
    """
    n, w = col(n).cast("int"), _double(w)
    top = F.floor(n * (n + 1) / 2).cast("int")
    none = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, _d(1)).otherwise(_d(0)))
    zeros = F.array_repeat(_d(0), n)

    def with_rank(ways, r):
        from_below = F.slice(F.concat(F.slice(zeros, F.lit(1), r), ways), F.lit(1), F.size(ways))
        return F.zip_with(ways, from_below, lambda a, b: a + b)

    ways = F.aggregate(F.sequence(F.lit(1), n), none, with_rank)
    upto = (F.least(F.floor(w), top.cast("long")) + 1).cast("int")
    hit = F.aggregate(F.slice(ways, F.lit(1), upto), _d(0), lambda s, x: s + x)
    return F.when((n > 0) & w.isNotNull(), F.when(w < 0, _d(0)).otherwise(hit / F.pow(_d(2), n.cast("double"))))


#: Nodes of the two quadratures of the range: the greatest value on an even grid, the others between
#: it and the least by Gauss's rule.
_GREATEST = [float(z) for z in np.arange(-8.5, 8.51, 0.1)]
_BETWEEN = list(zip(*(x.tolist() for x in np.polynomial.legendre.leggauss(28))))


def _nodes(values, fields: str) -> Column:
    rows = ", ".join("named_struct(" + ", ".join(f"'{f}', {v!r}D" for f, v in zip(fields.split(), x)) + ")"
                     for x in values)
    return F.expr(f"array({rows})")


def range_lower(q: ColumnLike, k: ColumnLike) -> Column:
    """P(R <= q) of the range of ``k`` standard normal values.

    One of them is the greatest, z, and the others lie within q below it.
    """
    q, k = _double(q), _double(k)
    scale = 1 / math.sqrt(2 * math.pi)
    greatest = _nodes([(z, scale * 0.1 * math.exp(-z * z / 2)) for z in _GREATEST], "z density")
    between = _nodes(_BETWEEN, "at weight")

    def add(s, node):
        inside = F.aggregate(between, _d(0), lambda t, g: t + g["weight"] * F.exp(
            -F.pow(node["z"] - s["half"] + s["half"] * g["at"], _d(2)) / 2)) * s["half"] * scale
        return F.struct(s["half"].alias("half"), s["k"].alias("k"), (
            s["total"] + node["density"] * F.pow(inside, s["k"] - 1)).alias("total"))

    start = F.struct((q / 2).alias("half"), k.alias("k"), _d(0).alias("total"))
    return F.when(q <= 0, _d(0)).otherwise(F.aggregate(greatest, start, add, lambda s: s["k"] * s["total"]))


def range_quantile(p: float, k: ColumnLike) -> Column:
    """The range that ``k`` standard normal values stay within with chance ``p``; NULL below two."""
    k = _double(k)

    def halve(s, m):
        mid = (s["low"] + s["high"]) / 2
        below = range_lower(mid, s["k"]) < p
        return {"k": s["k"], "low": F.when(below, mid).otherwise(s["low"]),
                "high": F.when(below, s["high"]).otherwise(mid)}

    return F.when(k >= 2, fold(HALVINGS, {"k": k, "low": _d(0), "high": _d(16)}, halve, "low"))


