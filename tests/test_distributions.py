import math

import numpy as np
import pytest

from panelgrid.functions import cdf
from panelgrid.functions import distributions as D
from panelgrid.functions.constants import NEMENYI_Q05


def values(spark, ddl, rows, *columns):
    got = spark.createDataFrame(rows, ddl).select(*columns).collect()
    return got[0] if len(rows) == 1 else [r[0] for r in got]


def test_log_gamma(spark):
    x = [0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 12345.5]
    got = values(spark, "x double", [(v,) for v in x], D.log_gamma("x"))
    assert got == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)


def test_gamma_and_chi2(spark):
    pairs = [(a, x) for a in (0.5, 1.0, 2.5, 20.0, 90.0) for x in (0.0, 1e-9, 0.3, 1.4, 8.0, 95.0, 300.0)]
    got = values(spark, "a double, x double", pairs, D.gamma_upper("a", "x"))
    assert got == pytest.approx([cdf.gamma_q(a, x) for a, x in pairs], rel=1e-9, abs=1e-14)
    got = values(spark, "x double, d double", [(3.841458820694124, 1.0), (5.0, 2.0), (1.0, 0.0)],
                 D.chi2_upper("x", "d"))
    assert got[:2] == pytest.approx([0.05, math.exp(-2.5)], abs=1e-12) and got[2] is None


def test_normal(spark):
    z = [-38.0, -8.0, -1.959963984540054, -0.1, 0.0, 0.5, 3.0, 9.0]
    got = values(spark, "z double", [(v,) for v in z], D.normal_lower("z"))
    assert got == pytest.approx([cdf.normal_cdf(v) for v in z], rel=1e-11)


def test_student(spark):
    pairs = [(t, d) for t in (0.0, 0.3, 1.0, 2.228138852, 12.706, 1e4, 1e200, float("inf"))
             for d in (1.0, 2.0, 10.0, 33.0, 1e4)]
    got = values(spark, "t double, d double", pairs, D.student_two_sided("t", "d"))
    want = [float(cdf.student_two_sided(min(t, 1e150), d)) for t, d in pairs]
    assert got == pytest.approx(want, rel=1e-8, abs=1e-15)
    assert values(spark, "t double, d double", [(2.228138852, 10.0)],
                  D.student_two_sided("t", "d"))[0] == pytest.approx(0.05, abs=1e-9)
    assert values(spark, "t double, d double", [(1.0, 0.0), (None, 3.0)],
                  D.student_two_sided("t", "d")) == [None, None]


def test_signed_rank(spark):
    pairs = [(1, 0.0), (1, 1.0), (5, -1.0), (5, 0.0), (5, 7.5), (5, 15.0), (5, 99.0), (20, 60.0), (50, 434.0)]
    got = values(spark, "n int, w double", pairs, D.signed_rank_lower("n", "w"))
    assert got == pytest.approx([cdf.signed_rank_lower_tail(n, w) for n, w in pairs], rel=1e-14)
    assert values(spark, "n int, w double", [(0, 1.0), (3, None)],
                  D.signed_rank_lower("n", "w")) == [None, None]


def test_range_quantile_against_published_values(spark):
    """Critical values at 5 %, divided by the root of two, for 2 to 20 treatments; 25 and 100 by simulation."""
    ks = list(NEMENYI_Q05)
    got = values(spark, "k int", [(k,) for k in ks], D.range_quantile(0.95, "k"))
    assert [g / math.sqrt(2) for g in got] == pytest.approx(list(NEMENYI_Q05.values()), abs=6e-7)
    r = np.random.default_rng(6)
    for k, q in zip((25, 100), values(spark, "k int", [(25,), (100,)], D.range_quantile(0.95, "k"))):
        inside = np.mean([(np.ptp(r.standard_normal((20_000, k)), axis=1) <= q).mean() for _ in range(10)])
        assert inside == pytest.approx(0.95, abs=2e-3)
    assert values(spark, "k int", [(1,), (None,)], D.range_quantile(0.95, "k")) == [None, None]


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(D.student_two_sided("id", "id").alias("p"), D.normal_lower("id").alias("z"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
