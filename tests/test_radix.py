import struct

import numpy as np
import pandas as pd
import pytest

from panelgrid.operators import radix as R


def hot_values(n=3000, seed=1):
    """A third of the rows share one value, a third one group."""
    r = np.random.default_rng(seed)
    v = np.where(np.arange(n) % 3 == 0, 0.25, r.normal(size=n).round(2))
    g = np.where(np.arange(n) % 3 == 1, "hot", r.choice(list("abcdef"), n))
    return pd.DataFrame({"g": g, "v": v})


def edge_values():
    """Powers of two and their neighbours, subnormals, extremes, both zeros and infinities."""
    p = 2.0 ** np.arange(-1074, 1024)
    near = np.concatenate([p, np.nextafter(p, 0), np.nextafter(p, np.inf)])
    r = np.random.default_rng(2).integers(0, 2047 << 52, 5000).view(np.float64)
    both = np.concatenate([near, r, [0.0, np.inf, 1.5, 0.1]])
    return np.unique(np.concatenate([both, -both]))


def test_keys_are_the_bits_and_keep_the_order(spark):
    values = edge_values()
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", R.double_key("v").alias("k"), R.key_double(R.double_key("v")).alias("back")).collect()
    for r in got:
        size = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-size if r.v < 0 else size) and r.back == r.v
    missing = spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "v double")
    assert [r[0] for r in missing.select(R.double_key("v")).collect()] == [None, None, 0]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles(spark, by):
    pdf = hot_values()
    extra = [("a", None), ("a", float("nan"))] + ([(None, 1.0)] if by else [])
    df = spark.createDataFrame(pdf).union(spark.createDataFrame(extra, "g string, v double"))
    probs = [0, .1, .25, .5, .75, .99, 1]
    got = R.exact_quantiles(df, "v", probs, by).toPandas()
    groups = pdf.groupby("g") if by else [("", pdf)]
    assert len(got) == (pdf.g.nunique() if by else 1)
    for k, part in groups:
        row = got[got.g == k].iloc[0] if by else got.iloc[0]
        assert row["n"] == len(part)
        want = np.quantile(part.v, probs)
        assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want), abs=1e-12)


def test_quantiles_of_close_and_of_distant_values(spark):
    r = np.random.default_rng(8)
    close = np.nextafter(1.0, 2) ** r.integers(0, 9, 500)
    distant = r.choice(edge_values()[np.abs(edge_values()) < 1e300], 500)
    for v in (close, distant):
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        got = R.exact_quantiles(df, "v", [0, .5, .9, 1]).first()[1:]
        assert list(got) == pytest.approx(list(np.quantile(v, [0, .5, .9, 1])), rel=1e-15)


def check_positions(spark, pdf):
    got = R.value_positions(spark.createDataFrame(pdf), "v", ["g"]).toPandas()
    assert len(got) == pdf.drop_duplicates().shape[0]
    for (g, v), part in pdf.groupby(["g", "v"]):
        row = got[(got.g == g) & (got.v == v)].iloc[0]
        inside = pdf[pdf.g == g]
        assert row.cnt == len(part) and row.start == (inside.v < v).sum()
        assert row.total == len(inside)


def test_positions(spark):
    check_positions(spark, hot_values())


def test_positions_digit_by_digit(spark, crowded):
    pdf = hot_values(900)
    pdf["v"] = pdf.v + np.where(np.arange(900) % 7 == 0, 2.0 ** -40, 0)
    check_positions(spark, pdf)


def test_single_value_and_none(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert R.exact_quantiles(df, "v", [0, .5, 1]).first()[1:] == (5.0, 5.0, 5.0)
    assert R.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert R.value_positions(df.limit(0), "v").count() == 0
    row = R.value_positions(df, "v").first()
    assert (row["v"], row["cnt"], row["start"], row["total"]) == (5.0, 1, 0, 1)


def test_no_sketch_and_no_sort_of_all_rows(spark):
    """Every plan that runs inside is looked at, not only the last."""
    df = spark.createDataFrame(hot_values())
    plans = []
    real = R.pin

    def spy(x, name):
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        return real(x, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "pin", spy)
        R.value_positions(df, "v", ["g"]).count()
    text = "\n".join(plans)
    assert plans and "percentile" not in text and "rangepartitioning" not in text
