import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelgrid.functions import cdf, constants
from panelgrid.functions import columns as C


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_month_end_and_index(spark):
    assert one(spark, C.month_end(F.lit(2000), F.lit(2))) == dt.date(2000, 2, 29)
    # rounded months since 31 January 1970, month = 30.436875 days, for every month end
    ends = spark.sql("SELECT last_day(add_months(DATE '1970-01-31', id)) AS d FROM range(0, 720)")
    rounded = F.round(F.datediff("d", F.lit(dt.date(1970, 1, 31))) / 30.436875)
    assert ends.where(rounded != C.month_index("d")).count() == 0
    assert C.parse_month("03-2004") == dt.date(2004, 3, 1)


@pytest.mark.parametrize("lon,want", [(-190, 170), (180, -180), (359.9, -0.1), (0, 0), (-180, -180)])
def test_wrap_lon(spark, lon, want):
    assert one(spark, C.wrap_lon(F.lit(float(lon)))) == pytest.approx(want)


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "b"), (-math.inf, "c"), (1.5, "d"),
                                (None, "e")], "v double, k string")
    got = {r["k"]: r["v"] for r in C.sanitize(df).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 1.5, "e": None}


def test_recode(spark):
    df = spark.createDataFrame([("CSH",), ("ENF",), ("zzz",), (None,)], "k string")
    m = constants.SITE_CODE_TO_CLASS
    assert [r[0] for r in df.select(C.recode("k", m, True)).collect()] == ["SH", "ENF", "zzz", None]
    assert [r[0] for r in df.select(C.recode("k", m)).collect()] == ["SH", "ENF", None, None]


def test_uniform_is_reproducible_and_spread(spark):
    df = spark.range(10000).select("id", C.uniform(3, "id").alias("u"))
    a = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 < a[1] and a[2] < 1
    again = spark.range(10000).repartition(13).select("id", C.uniform(3, "id").alias("u"))
    assert df.exceptAll(again).count() == 0


@pytest.mark.parametrize("n,res,tot,want", [(1, 0.0, 0.0, None), (3, 0.0, 0.0, 1.0),
                                            (3, 2.0, 0.0, 0.0), (3, 1.0, 4.0, 0.75)])
def test_r2_from_sums(spark, n, res, tot, want):
    assert one(spark, C.r2_from_sums(F.lit(n), F.lit(res), F.lit(tot))) == want


def test_constants():
    assert len(constants.LAND_COVER) == 17 and len(set(constants.CODE_TO_CLASS.values())) == 15
    assert len(constants.VARIABLE_SETS) == 12
    assert constants.PIXEL_CODE_TO_CLASS[0] == "NAN" and constants.PIXEL_CODE_TO_CLASS[17] == "WAT"


def test_distributions():
    published = {1: 12.7062, 5: 2.5706, 10: 2.2281, 30: 2.0423, 100: 1.9840}
    for dof, t in published.items():
        assert float(cdf.student_critical([dof])[0]) == pytest.approx(t, abs=1e-4)
    assert cdf.gamma_q(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-7)
    assert cdf.gamma_q(2.0, 0.5) == pytest.approx(math.exp(-0.5) * 1.5)
    assert cdf.gamma_q(2.0, 9.0) == pytest.approx(math.exp(-9) * 10)
    assert cdf.normal_cdf(1.959964) == pytest.approx(0.975, abs=1e-7)
    assert float(cdf.student_two_sided(2.2281388, 10)) == pytest.approx(0.05, abs=1e-6)
    assert float(cdf.student_two_sided(0.0, 10)) == pytest.approx(1.0)
    assert cdf.signed_rank_lower_tail(5, 0) == 1 / 32
    assert cdf.signed_rank_lower_tail(5, 15) == 1.0
