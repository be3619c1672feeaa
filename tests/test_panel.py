"""Season, anomaly, trend, gap filling and scores against plain NumPy on small panels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import panel, scores


def make_panel(seed=0, reps=2):
    r = np.random.default_rng(seed)
    rows = []
    for rep in range(reps):
        for s, months in (("A", 60), ("B", 37), ("C", 1), ("D", 24), ("flat", 30)):
            dates = pd.date_range("2001-03-31", periods=months, freq="ME")
            gt = 5 + np.sin(dates.month / 2) + r.normal(size=months) + np.arange(months) * 0.02
            if s == "flat":
                gt = np.full(months, 2.0)
            pred = gt + r.normal(size=months) * 0.5
            for d, a, b in zip(dates, gt, pred):
                rows.append((rep, s, d.date(), float(a), float(b)))
    return pd.DataFrame(rows, columns=["rep", "site", "date", "gt", "pred"])


def to_spark(spark, pdf):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in t)
            for t in pdf.itertuples(index=False)]
    types = {"rep": "int", "site": "string", "date": "date"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {types.get(c, 'double')}" for c in pdf))


def month_no(d):
    return (d.year - 1970) * 12 + d.month - 1


def season(p, c):
    return p.groupby(["site", p.date.map(lambda d: d.month)])[c].transform("mean")


def line(p, y):
    out = pd.Series(np.nan, index=p.index)
    for _, g in p.groupby("site"):
        ok = y.loc[g.index].notna()
        g = g[ok]
        x, v = g.date.map(month_no).astype(float), y.loc[g.index]
        if len(g):
            b = 0.0 if x.nunique() < 2 else np.polyfit(x - x.mean(), v, 1)[0]
            out.loc[g.index] = v.mean() + b * (x - x.mean())
    return out


def slopes(p, c):
    return p.groupby("site").apply(lambda g: 0.0 if len(g) < 2 else np.polyfit(
        g.date.map(month_no) - 400, g[c], 1)[0], include_groups=False)


def r2(a, b):
    return 1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum()


def rmse(a, b):
    return np.sqrt(((a - b) ** 2).mean())


def expected_metrics(p):
    out = {}
    a, b = [p[c] - season(p, c) for c in ("gt", "pred")]
    at, bt = a - line(p, a), b - line(p, b)
    m = p.groupby(["site", p.date.map(lambda d: d.month)])[["gt", "pred"]].mean()
    s = p.groupby("site")[["gt", "pred"]].mean()
    parts = {"overall": (p["gt"], p.pred), "trend": (slopes(p, "gt"), slopes(p, "pred")),
             "anomalies": (at, bt), "sites": (s["gt"], s.pred), "msc": (m["gt"], m.pred)}
    for k, (x, y) in parts.items():
        out[f"r2_{k}"] = r2(x, y)
        out[f"rmse_{k}"] = rmse(x, b) if k == "anomalies" else rmse(x, y)
    return out


@pytest.mark.parametrize("min_months", [0, 30])
def test_eval_metrics(spark, min_months):
    pdf = make_panel()
    got = scores.eval_metrics(to_spark(spark, pdf), min_months=min_months).toPandas().set_index("rep")
    for rep, p in pdf.groupby("rep"):
        p = p[p.groupby("site")["gt"].transform("count") >= min_months]
        for k, v in expected_metrics(p).items():
            assert got.loc[rep, k] == pytest.approx(v, rel=1e-9), k


def test_eval_metrics_drops_incomplete_pairs_but_counts_truth(spark):
    pdf = make_panel(reps=1)
    pdf.loc[pdf.index % 5 == 0, "pred"] = np.nan
    got = scores.eval_metrics(to_spark(spark, pdf), min_months=24).first().asDict()
    keep = pdf[pdf.groupby("site")["gt"].transform("count") >= 24].dropna()
    for k, v in expected_metrics(keep).items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_eval_metrics_without_keys(spark):
    pdf = make_panel(reps=1)
    a = scores.eval_metrics(to_spark(spark, pdf), keys=()).first()
    b = scores.eval_metrics(to_spark(spark, pdf)).first()
    assert a["r2_overall"] == pytest.approx(b["r2_overall"])


def test_eval_by_class_edge_sites(spark):
    pdf = make_panel(reps=1)
    sites = spark.createDataFrame([("A", "X"), ("C", "X"), ("flat", "Y"), ("B", None)],
                                  "site string, class string")
    got = {r["site"]: r for r in scores.eval_by_class(to_spark(spark, pdf), sites).collect()}
    assert set(got) == {"A", "C", "flat"}          # no class: no row
    assert got["C"]["r2_overall"] is None          # one month
    assert got["flat"]["r2_overall"] == 0.0        # constant truth, missed
    p = pdf[pdf.site == "A"]
    assert got["A"]["r2_overall"] == pytest.approx(r2(p["gt"], p.pred))


@pytest.mark.parametrize("detrend", [False, True])
def test_iav(spark, detrend):
    pdf = make_panel(reps=1).drop(columns="rep")
    pdf.loc[pdf.index % 7 == 0, "gt"] = np.nan
    got = panel.iav(to_spark(spark, pdf), "gt", detrend=detrend).toPandas()
    got = got.set_index(["site", "date"]).iav
    want = pdf["gt"] - season(pdf, "gt")
    if detrend:
        want = want - line(pdf, want)
    want.index = pd.MultiIndex.from_frame(pdf[["site", "date"]])
    assert got.reindex(want.index).values == pytest.approx(want.values, abs=1e-9, nan_ok=True)
    if detrend:  # mean zero and no slope left
        left = got.dropna().reset_index().query("site == 'A'")
        assert left.iav.mean() == pytest.approx(0, abs=1e-9)
        assert np.polyfit(left.date.map(month_no), left.iav, 1)[0] == pytest.approx(0, abs=1e-9)


def test_trend_and_across_site_trend(spark):
    pdf = make_panel(reps=1).drop(columns="rep")
    df = to_spark(spark, pdf)
    got = panel.trend(df, "gt").toPandas().set_index(["site", "date"]).trend
    want = line(pdf, pdf["gt"])
    want.index = pd.MultiIndex.from_frame(pdf[["site", "date"]])
    assert got.reindex(want.index).values == pytest.approx(want.values, abs=1e-9)
    b = {r["site"]: r["gt"] for r in panel.across_site_trend(df, ["gt"]).collect()}
    assert b["C"] == 0.0 and b["flat"] == pytest.approx(0, abs=1e-12)
    assert b["A"] == pytest.approx(slopes(pdf, "gt")["A"])


def test_msc_no_mean_sums_to_zero(spark):
    pdf = make_panel(reps=1).drop(columns="rep")
    g = panel.msc(to_spark(spark, pdf), "gt", no_mean=True).toPandas()
    p = pdf.copy()
    p["gt"] = p["gt"] - p.groupby("site")["gt"].transform("mean")
    want = p.groupby(["site", p.date.map(lambda d: d.month)])["gt"].mean()
    got = g.set_index(["site", "month"]).msc
    assert got.reindex(want.index).values == pytest.approx(want.values, abs=1e-12)


def test_gap_fill(spark):
    rows = [("A", f"2001-{m:02d}-28", v, w) for m, v, w in [
        (1, None, 1.0), (2, 2.0, None), (3, None, 3.0), (4, None, 4.0), (5, 6.0, None), (6, None, 9.0)]]
    rows += [("A", "2002-01-31", None, None), ("A", "2003-01-31", 10.0, None), ("B", "2001-01-31", None, 1.0)]
    df = spark.createDataFrame(rows, "site string, d string, v double, w double").select(
        "site", F.to_date("d").alias("date"), "v", "w")
    got = [tuple(r)[2:] for r in panel.gap_fill(df, ["v", "w"]).orderBy("site", "date").collect()]
    assert [g[0] for g in got] == [None, 2.0, 4.0, 4.0, 6.0, 8.0, 8.0, 10.0, None]
    assert [g[1] for g in got] == [1.0, 2.0, 3.0, 4.0, 6.5, 9.0, None, None, 1.0]


def test_filters_and_class_changes(spark):
    df = spark.createDataFrame([("a", "2001-01-31", 1.0, "X"), ("a", "2001-02-28", None, "Y"),
                                ("b", "2001-02-28", None, "X"), ("b", "2001-03-31", 2.0, None)],
                               "site string, d string, v double, c string").select(
        "site", F.to_date("d").alias("date"), "v", "c")
    assert panel.drop_empty_dates(df, "v").count() == 2
    assert panel.min_months(df, "v", 2).count() == 0
    assert panel.min_months(df, "v", 0).count() == 4
    assert [r[0] for r in panel.class_changed(df, "c").collect()] == ["a"]
    last = {r["site"]: r["c"] for r in panel.last_per_site(df, ["c"]).collect()}
    assert last == {"a": "Y", "b": None}


def test_bias_bins_share_their_edges(spark):
    df = spark.createDataFrame([(float(k), float(k) + 1) for k in range(5)], "gt double, p double")
    got = scores.bias_by_quantile(df, "gt", "p").orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 2, 2, 2]    # 0,1 | 1,2 | 2,3 | 3,4
    assert all(r["median_bias"] == 1.0 for r in got)


def test_location_r2_missing_sides(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, None), (1, 4.0, 3.0), (2, 1.0, None), (2, 3.0, None),
                                (3, None, 1.0), (4, 2.0, 2.0)], "loc int, a double, p double")
    got = {r["loc"]: r["r2_a"] for r in scores.location_r2(df, ["a"], "p").collect()}
    m = 7 / 3
    assert got[1] == pytest.approx(1 - 1.0 / ((1 - m) ** 2 + (2 - m) ** 2 + (4 - m) ** 2))
    assert got[2] == 1.0 and got[3] is None and got[4] is None
