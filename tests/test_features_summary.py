import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelgrid.functions.constants import CODE_TO_CLASS, COVARIATE_DATASETS, VARIABLE_SETS
from panelgrid.operators import clean, features, summarize


def wide(spark):
    cols = sorted({c for v in VARIABLE_SETS.values() for c in v} - {"year", "MODIS_LC"})
    df = spark.createDataFrame([("a", dt.date(2003, 4, 30), "ENF"), ("b", dt.date(2004, 4, 30), None)],
                               "site string, date date, MODIS_LC string")
    return df.select("*", *[F.lit(1.0).alias(c) for c in cols], F.lit(9.0).alias("gt"))


@pytest.mark.parametrize("name", list(VARIABLE_SETS))
def test_every_variable_set(spark, name):
    out = features.feature_set(wide(spark), name, target=["gt"])
    assert out.columns == ["site", "date", *VARIABLE_SETS[name], "gt"]
    if "year" in out.columns:
        assert {r["year"] for r in out.collect()} == {2003, 2004}


def test_feature_set_options(spark):
    df = wide(spark)
    with pytest.raises(ValueError, match="unknown"):
        features.feature_set(df, "nope")
    out = features.feature_set(df, ["b1", "MODIS_LC"], encode=["MODIS_LC"])
    assert out.columns == ["site", "date", "b1", "MODIS_LC_ENF"]        # no column for NULL
    assert [r["MODIS_LC_ENF"] for r in out.orderBy("site").collect()] == [1.0, 0.0]
    # a second call starts afresh
    assert features.feature_set(df, ["b1", "MODIS_LC"]).columns == ["site", "date", "b1", "MODIS_LC"]
    empty = df.withColumn("b1", F.when(F.col("site") == "a", F.col("b1")))
    assert features.feature_set(empty, ["b1"]).count() == 1
    assert features.feature_set(empty, ["b1"], rm_all_nulls=False).count() == 2


def test_one_hot_guard(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CLASSES", 3)
    with pytest.raises(ValueError):
        features.one_hot(spark.range(10).select(F.col("id").cast("string").alias("c")), "c")


def test_reverse_one_hot_first_wins(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 0.0, 0.0), (None, 0.5, 0.1), (None, None, None)],
                               "a double, b double, c double")
    got = [r["top"] for r in features.reverse_one_hot(df, ["a", "b", "c"], "top").collect()]
    assert got == ["b", "a", "b", None]


def test_rows(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (0.0, 0.0), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(features.row_mean(["a", "b"])).collect()]
    assert got == [2.0, 2.0, 0.0, None]
    got = [tuple(r) for r in features.row_shares(df, ["a", "b"]).collect()]
    assert got == [(0.25, 0.75), (None, 1.0), (None, None), (None, None)]


def test_store_names():
    f = ["b1", "BESS-PAR", "MODIS_LC_ENF", "MODIS_LC_WET", "Lai"]
    assert features.store_names(f) == ["b1", "BESS_PAR", "IGBP", "Lai"]
    need = features.needed_datasets(f, COVARIATE_DATASETS)
    assert need["MCD12Q1"] == ["IGBP"] and need["MODIS_LAI"] == ["Lai"] and need["CSIF"] == []


def test_cleaning_keeps_missing_classes(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 0.9, None), ("b", 1.0, 0.0, 0.9, "WAT"),
                                ("c", None, 0.0, 0.9, "ENF"), ("d", 1.0, -1.0, 0.9, "ENF"),
                                ("e", 1.0, 0.0, 0.8, "ENF"), ("f", 1.0, 0.0, 0.9, "ENF")],
                               "site string, flux double, v double, qc double, c string")
    kept = [r["site"] for r in clean.quality_filter(df, "flux", "v", "qc", "c").collect()]
    assert kept == ["a", "f"]
    assert [r["site"] for r in clean.exclude_classes(df, "c", ["WAT", "ENF"]).collect()] == ["a"]
    patched = clean.apply_patches(df, "site", "c", {"a": "GRA"})
    assert [r["c"] for r in patched.orderBy("site").collect()][:2] == ["GRA", "WAT"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, -0.1, 2.1, None)], "v double")
    got = {r["bin"]: r for r in summarize.histogram(df, "v", 0, 2, 4).collect()}
    assert [got[b]["n"] for b in range(4)] == [1, 1, 1, 1]      # the upper limit is in the last bin
    assert sum(r["density"] * 0.5 for r in got.values()) == pytest.approx(1.0)
    assert got[0]["err"] == 1.0 and got[0]["density_err"] == pytest.approx((1 / 4) ** 0.5)
    part = summarize.binned_shares(df.na.drop().withColumns({"a": F.lit(1), "b": F.lit(3)}), "v",
                                   ["a", "b"], 0, 2, 4).collect()
    assert sum(r["n"] for r in part) == 3 and {r["a"] for r in part} == {0.25}   # 2.0 is out here


def test_confusion_matrix_empty_rows(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), (None, "x")],
                               "truth string, pred string")
    got = {(r["truth"], r["pred"]): r["share"] for r in summarize.confusion_matrix(df).collect()}
    assert len(got) == 9 and got["x", "z"] == pytest.approx(1 / 3)
    assert got["z", "z"] == 0.0 and got["y", "x"] == 0.0
    assert summarize.confusion_matrix(df, dense=False).count() == 4


def test_box_whiskers(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", x) for x in v], "k string, v double")
    b = summarize.box_stats(df, "v", ["k"]).first()
    assert (b["q1"], b["median"], b["q3"]) == (2, 3, 4)
    assert (b["whisker_low"], b["whisker_high"], b["outliers"]) == (1, 4, 1)


def test_groups(spark):
    df = spark.createDataFrame([("a", 2.0, 1, "p"), ("a", 2.0, 0, "q"), ("b", 5.0, 3, "r"), ("b", None, 4, "s")],
                               "k string, score double, id int, name string")
    best = {r["k"]: r["name"] for r in summarize.best_per_group(df, ["k"], "score", ["id"], ["name"]).collect()}
    assert best == {"a": "q", "b": "r"}
    scaled = summarize.minmax_scale(df, "score", ["k"]).collect()
    assert all(r["scaled"] is None for r in scaled)
    piv = summarize.pivot_counts(df, ["k"], "name", ["p", "x"]).orderBy("k").collect()
    assert [tuple(r) for r in piv] == [("a", 1, 0), ("b", 0, 0)]
    assert summarize.melt(df, ["k"], ["score"], drop_null=True).count() == 3
    fam = spark.createDataFrame([("GBM_grid_1_AutoML_2",)], "m string").select(
        summarize.model_family("m"), summarize.model_family("m", 2)).first()
    assert tuple(fam) == ("GBM", "GBM grid")


def test_unknown_codes(spark):
    df = spark.createDataFrame([(0,), (17,), (18,), (None,)], "c int")
    got = [r[0] for r in clean.recode_column(df, "c", CODE_TO_CLASS, keep_unknown=False).collect()]
    assert got == [None, "WAT", None, None]
