import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelgrid.functions.cdf import student_two_sided
from panelgrid.operators import grid, maps, sample
from panelgrid.plans.catalog import QUERIES


def axis(spark, vals):
    return spark.createDataFrame([(float(v),) for v in vals], "lon double")


def snapped(spark, targets, sources, **kw):
    out = grid.snap_axis(axis(spark, targets), axis(spark, sources), "lon", **kw).collect()
    return {r["lon"]: r["snapped"] for r in out}


def test_snap_ties_and_edges(spark):
    got = snapped(spark, [-5, 0, 1, 1.5, 2, 3, 9], [0, 2, 4])
    assert got == {-5: 0, 0: 0, 1: 2, 1.5: 2, 2: 2, 3: 4, 9: 4}      # ties go up, edges clamp
    got = snapped(spark, [-5, 1.5, 4, 9], [0, 2, 4], outside="null")
    assert got == {-5: None, 1.5: 2, 4: 4, 9: None}


def test_snap_around_the_date_line(spark):
    src = [-179.0, 0.0, 170.0]
    assert snapped(spark, [179.5], src)[179.5] == 170.0
    assert snapped(spark, [179.5], src, period=360.0)[179.5] == -179.0


def test_snap_random(spark):
    r = np.random.default_rng(0)
    t, s = r.uniform(-180, 180, 400).round(3), np.unique(r.uniform(-180, 180, 90).round(3))
    got = snapped(spark, t, s)
    for v in t:
        near = s[np.abs(s - v) == np.abs(s - v).min()].max()
        assert got[v] == near


def cells(spark, rows, names="lat double, lon double, v double"):
    return spark.createDataFrame(rows, names)


def test_masks(spark):
    df = cells(spark, [(0.0, 0.0, 5.0), (0.0, 1.0, 6.0), (1.0, 0.0, -7.0), (1.0, 1.0, 8.0)])
    veg = cells(spark, [(0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 1.0)], "lat double, lon double, m double")
    land = cells(spark, [(a, b + 360, float(a + b < 2)) for a in (0.0, 1.0) for b in (0.0, 1.0)],
                 "lat double, lon double, m double")
    out = grid.apply_mask(df, ["v"], land=land, vegetation=veg, sea_value=-1.0, bare_value=-2.0)
    got = {(r["lat"], r["lon"]): r["v"] for r in out.collect()}
    # (1, 1) has no vegetation cell: bare first, then sea wins
    assert got == {(0, 0): 5, (0, 1): -2, (1, 0): -7, (1, 1): -1}
    out = grid.apply_mask(df, ["v"], custom=veg, custom_value=None, invalid_to_zero=True)
    got = {(r["lat"], r["lon"]): r["v"] for r in out.collect()}
    assert got == {(0, 0): 5, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    assert grid.apply_mask(df, ["v"]).exceptAll(df).count() == 0


def test_stride(spark):
    df = spark.range(12).select(F.lit(0.0).alias("lat"), (F.col("id") * 2.5).alias("lon"))
    assert sorted(r["lon"] for r in grid.grid_stride(df, 5).collect()) == [0.0, 12.5, 25.0]


def test_merge_exact(spark):
    a = cells(spark, [(0.0, 0.0, 1.0), (0.0, 1.0, 2.0)])
    b = a.withColumnRenamed("v", "w")
    assert grid.merge_exact(a, b, ["lat", "lon"]).count() == 2
    with pytest.raises(PySparkException, match="differ"):
        grid.merge_exact(a, b.where("lon > 0"), ["lat", "lon"]).collect()


def test_merge_exact_past_the_date_line(spark, tmp_path):
    """Suppliers from 1,000 on lie beyond 180 degrees; 7 and 21,007 share a cell, 1,000 is at -180."""
    day = dt.datetime(2001, 1, 5)
    rows = [(s, rep, q, tax, "A", day) for s, rep, q, tax in [
        (7, 1, 7.0, 0.0), (7, 2, 21.0, 0.0), (21_007, 1, 35.0, 0.6), (1_000, 1, 14.0, 0.5), (499, 1, 28.0, 0.25)]]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_tax double, "
                                  "l_returnflag string, l_shipdate timestamp")
    lines.select("*", F.lit(1).alias("l_partkey"), F.lit(1.0).alias("l_extendedprice"),
                 F.lit(0.0).alias("l_discount"), F.lit("F").alias("l_linestatus")
                 ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["lat"], r["lon"]): (r["time"], r["v"], r["c"])
           for r in QUERIES["merge_exact"](spark, str(tmp_path)).collect()}
    # every value of a cell counts alike: (1 + 3 + 5) / 3 of the ensemble and (2 + 8) / 2 of the product
    assert got == {(-12.5, -180.0): ("2001-01-31", 3.0, 5.0), (-47.5, -180.0): ("2001-01-31", 2.0, 3.0),
                   (47.5, -7.2): ("2001-01-31", 4.0, 5.0)}


def test_merge_grids_keeps_cells_of_any_grid(spark):
    t = F.lit(dt.date(2001, 1, 31))
    a = cells(spark, [(0.0, 0.0, 1.0), (0.0, 0.0, 3.0)]).withColumn("time", t)
    b = cells(spark, [(5.0, 5.0, None), (0.0, 0.0, 4.0)]).withColumn("time", t)
    got = {(r["lat"], r["lon"]): (r["a"], r["b"]) for r in grid.merge_grids({"a": a, "b": b}).collect()}
    assert got == {(0, 0): (2.0, 4.0), (5, 5): (None, None)}


def test_resample_fill(spark):
    df = spark.createDataFrame([(1, dt.date(2001, 1, 5), 1.0), (1, dt.date(2001, 1, 9), 3.0),
                                (2, dt.date(2001, 3, 9), 5.0)], "k int, time date, v double")
    got = {(r["k"], r["time"].month): r["v"]
           for r in grid.resample_monthly(df, ["k"], ["v"], fill_gaps=True).collect()}
    assert got == {(1, 1): 2.0, (1, 2): None, (1, 3): None, (2, 1): None, (2, 2): None, (2, 3): 5.0}


def cube(spark, fn, years=8, reps=3):
    rows = []
    for lat in (0.0, 10.0):
        for d in pd.date_range("2001-01-31", periods=12 * years, freq="ME"):
            for rep in range(reps):
                rows.append((lat, 0.0, d.date(), rep, float(fn(lat, d, rep))))
    return spark.createDataFrame(rows, "lat double, lon double, time date, rep int, v double"), rows


def test_maps_of_a_constant(spark):
    df, _ = cube(spark, lambda *a: 4.0, years=3)
    assert {r["mean"] for r in maps.map_mean(df).collect()} == {4.0}
    assert {r["amplitude"] for r in maps.map_msc(df).collect()} == {0.0}
    assert {r["anomaly_std"] for r in maps.map_anomalies(df).collect()} == {0.0}
    assert {r["std_err"] for r in maps.map_err(df).collect()} == {0.0}
    assert {r["slope"] for r in maps.map_trend(df).collect()} == {None}


def test_maps_against_numpy(spark):
    r = np.random.default_rng(5)
    df, rows = cube(spark, lambda lat, d, rep: (d.year - 2001) * lat / 40 + r.normal() + 3)
    p = pd.DataFrame(rows, columns=["lat", "lon", "time", "rep", "v"])
    p["time"] = pd.to_datetime(p.time)
    p = p.sample(frac=0.9, random_state=1)
    df = df.sparkSession.createDataFrame(p.assign(time=p.time.dt.date), df.schema)
    for lat, g in p.groupby("lat"):
        m = g.groupby("time").v.mean()
        clim = m.groupby(m.index.month)
        def pick(d, c):
            return d.where(F.col("lat") == lat).first()[c]
        assert pick(maps.map_mean(df), "mean") == pytest.approx(g.v.mean())
        assert pick(maps.map_msc(df), "amplitude") == pytest.approx(
            (clim.mean().max() - clim.mean().min()) / 2)
        assert pick(maps.map_anomalies(df), "anomaly_std") == pytest.approx(
            (m - clim.transform("mean")).std(ddof=0))
        se = g.groupby("time").v.agg(lambda x: x.std(ddof=0) / np.sqrt(len(x))).mean()
        assert pick(maps.map_err(df), "std_err") == pytest.approx(se)
        assert pick(maps.map_err(df, relative=True), "std_err_pct") == pytest.approx(
            100 * se / abs(g.v.mean()))
        y = m.groupby(m.index.year).mean() * 372
        x = y.index.values.astype(float)
        b, a = np.polyfit(x - x.mean(), y, 1)
        res = ((y - a - b * (x - x.mean())) ** 2).sum()
        t = abs(b) / np.sqrt(res / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
        pval = float(student_two_sided(t, len(x) - 2))
        got = maps.map_trend(df, with_p=True).where(F.col("lat") == lat).first()
        assert got["all_slopes"] == pytest.approx(b) and got["p_value"] == pytest.approx(pval)
        assert (got["slope"] is not None) == (pval < 0.05)


def test_unmapped_classes_are_not_reported(spark):
    df, _ = cube(spark, lambda lat, d, rep: 1 + rep, years=1, reps=2)
    codes = df.select("lat", "lon", "time").distinct().where("lat = 0").withColumn(
        "code", F.when(F.month("time") == 1, 3).when(F.month("time") == 2, 7).otherwise(17))
    got = maps.rel_sem_by_class(df, codes).collect()
    assert [(r["key"], round(r["value"], 6)) for r in got] == [("SH", round(0.5 / 2 ** .5 / 1.5, 6))]


def test_area_sample_ignores_partitioning(spark):
    g = spark.range(2000).select((F.floor(F.col("id") / 40) * 3.5 - 87).alias("lat"),
                                 ((F.col("id") % 40) * 9.0 - 180).alias("lon"))
    a = sample.area_sample(g, 50, seed=2)
    b = sample.area_sample(g.repartition(17), 50, seed=2)
    assert a.exceptAll(b).count() == 0 and a.select("lat", "lon").distinct().count() == 50
    assert sample.area_sample(g, 50, seed=3).exceptAll(a).count() > 0


def test_area_sample_with_replacement_follows_the_area(spark):
    g = spark.createDataFrame([(0.0, 0.0), (60.0, 0.0), (90.0, 0.0)], "lat double, lon double")
    d = sample.area_sample_with_replacement(g, 6000, seed=1)
    n = {r["lat"]: r["count"] for r in d.groupBy("lat").count().collect()}
    assert sum(n.values()) == 6000 and d.select("loc").distinct().count() == 6000
    assert n[0.0] / 6000 == pytest.approx(2 / 3, abs=0.03) and n.get(90.0, 0) == 0
