"""Tuning inside training folds and layered stacks, against least squares done by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelgrid.operators import ml, split


def panel(n=160, sites=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    site = [f"s{i % sites}" for i in range(n)]
    y = 2 * x[:, 0] - x[:, 1] + r.normal(size=n) * 0.3
    return pd.DataFrame({"site": site, "date": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "gt": y})


def least_squares(fit, columns, held):
    design = lambda p: np.column_stack([np.ones(len(p)), p[columns]])
    beta, *_ = np.linalg.lstsq(design(fit), fit.y, rcond=None)
    return design(held) @ beta


def folds_of(spark, pdf, k, seed):
    rows = spark.createDataFrame(pdf[["site", "strat"]])
    return {r.site: r.fold for r in split.group_kfold(rows, "site", "strat", k, seed).collect()}


def test_rungs():
    assert ml.rungs(1) == [] and ml.rungs(2) == [(2, 1.0)]
    assert ml.rungs(5) == [(5, 0.25), (3, 0.5), (2, 1.0)]
    assert ml.rungs(12)[0] == (12, 0.125) and ml.rungs(12)[-1] == (2, 1.0)


def test_tuning_finds_the_informative_feature(spark):
    df = spark.createDataFrame(panel()).withColumn("strat", F.lit("all")).withColumn("y", F.col("gt"))
    pool = {n: (LinearRegression(), [n]) for n in "abc"}
    name, log = ml.tune(df, pool, list("abc"), k=3)
    assert name == "a"
    assert [x["share"] for x in log] == [0.5] * 3 + [1.0] * 2
    assert sum(x["kept"] for x in log) == 3
    assert ml.tune(df, {"only": LinearRegression()}, list("abc")) == ("only", [])


def test_outer_sites_have_no_say(spark):
    """Changing the targets of a fold's sites changes neither its models nor its predictions."""
    pdf = panel()
    pool = {n: (LinearRegression(), [n]) for n in "ab"}
    p, log = ml.nested_cv(spark.createDataFrame(pdf), pool, ["a", "b"], k=2, inner_k=2)
    first = p.where("fold = 0").toPandas()
    assert set(log.toPandas().fold) == {0, 1}
    pdf.loc[pdf.site.isin(first.site), "gt"] += 50 * np.arange(len(pdf))[pdf.site.isin(first.site)]
    again = ml.nested_cv(spark.createDataFrame(pdf), pool, ["a", "b"], k=2, inner_k=2)[0].where("fold = 0")
    a, b = (x.sort_values("date") for x in (first, again.toPandas()))
    assert np.allclose(a.y_pred, b.y_pred) and list(a.model) == list(b.model)


@pytest.mark.parametrize("layers,bags", [(1, 1), (2, 2)])
def test_stack_against_least_squares(spark, monkeypatch, layers, bags):
    monkeypatch.setattr(ml, "_meta", LinearRegression)
    pdf = panel(80).assign(strat="all").rename(columns={"gt": "y"})
    train, new = pdf[pdf.date < 60].copy(), pdf[pdf.date >= 60].copy()
    pool = {"wide": LinearRegression(), "narrow": (LinearRegression(), ["b"])}
    model = ml.fit_stack(spark.createDataFrame(train), pool, ["a", "c"], layers, 3, bags, 5)
    assert set(ml.feature_names(model)) == {"a", "b", "c"}
    got = model.transform(spark.createDataFrame(new)).select("date", "prediction").toPandas().sort_values("date")

    known = ["a", "c"]
    fold_maps = [folds_of(spark, train, 3, 5 + b) for b in range(bags)]
    for layer in range(1, layers + 1):
        columns = {"wide": known, "narrow": ["b"]}
        for name, cols in columns.items():
            new[f"{name}_{layer}"] = least_squares(train, cols, new)
        oof = {}
        for name, cols in columns.items():
            total = np.zeros(len(train))
            for folds in fold_maps:
                part = train.site.map(folds).to_numpy()
                for f in range(3):
                    total[part == f] += least_squares(train[part != f], cols, train[part == f])
            oof[name] = total / bags
        for name, values in oof.items():
            train[f"{name}_{layer}"] = values
        known = ["a", "c", *(f"{n}_{layer}" for n in columns)]
    want = least_squares(train, known[2:], new)
    assert np.allclose(got.prediction, want, atol=1e-6)


def test_saved_stack(spark, tmp_path):
    pdf = panel(60).assign(strat="all").rename(columns={"gt": "y"})
    df = spark.createDataFrame(pdf)
    model = ml.fit_stack(df, {"wide": LinearRegression()}, ["a", "b"], k=2)
    ml.save_model(model, str(tmp_path / "m"))
    back = ml.load_model(str(tmp_path / "m"))
    assert ml.feature_names(back) == ["a", "b"]
    assert np.allclose(*(m.transform(df).orderBy("date").toPandas().prediction for m in (model, back)))
