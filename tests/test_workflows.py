"""Whole runs on the smallest tables: clean, train, save, evaluate, upscale, map, compare."""

import pytest
from pyspark.sql import functions as F

from panelgrid import workflows as W
from panelgrid.config import ExperimentConfig
from panelgrid.functions.columns import recode
from panelgrid.functions.constants import CODE_TO_CLASS
from panelgrid.plans.views import Views
from panelgrid.sources import experiments, grids

SF = "/root/testdata/sf0.001"
FOREST = ExperimentConfig("t", "random_forest", "rs_min", {"n_estimators": [3, 5], "max_depth": [3],
                                                           "min_samples_leaf": [2], "n_iter": 2},
                          n_folds_cv=2, n_folds_tuning=2)


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


@pytest.fixture(scope="module")
def records(v):
    return v.site_features.withColumn("MODIS_LC", recode("lc", CODE_TO_CLASS)).drop("lc")


def test_cv_and_evaluation(spark, v, records, tmp_path):
    root = str(tmp_path)
    ids = [W.run_cv(spark, records, FOREST, root, "7", rep, target="gt") for rep in (0, 1)]
    p = experiments.load_predictions(spark, root, ids[0])
    assert p.count() == p.select("site", "date").distinct().count() > 0
    assert experiments.load_config(spark, root, ids[1]) == FOREST
    assert experiments.load_features(spark, root, ids[0]).count() >= p.count()
    sites = v.site_meta.select(F.col("site").cast("string").alias("site"), F.col("class").alias("IGBP"))
    out = W.evaluate(spark, root, ids[0][:-1], 12, sites)
    assert {r["exp_id"] for r in out["metrics"].collect()} == set(ids)
    assert out["metrics_by_class"].count() == 2 * p.select("site").distinct().count()


def test_leaderboard_run(spark, records, tmp_path):
    cfg = ExperimentConfig("t", "stacked", "rs_min", {"candidates": 1}, n_folds_cv=2)
    exp = W.run_cv(spark, records, cfg, str(tmp_path), "8", target="gt")
    assert experiments.load_predictions(spark, str(tmp_path), exp).count() > 0


def test_bootstrap_upscale_and_maps(spark, v, records, tmp_path):
    root = str(tmp_path)
    exp = W.run_bootstrap(spark, records, FOREST, root, "9", target="gt")
    roles = experiments.load_folds(spark, root, exp)
    assert {r["role"] for r in roles.select("role").distinct().collect()} == {"train", "test"}
    lat, lon = v.lat_lon("site")
    wide = v.site_features.na.fill(0.1, ["b1", "b2", "b3"]).select(
        lat.alias("lat"), lon.alias("lon"), F.col("date").alias("time"),
        *[f"b{k}" for k in range(1, 8)], F.col("BESS-PAR").alias("BESS_PAR"))
    long = wide.unpivot(["lat", "lon", "time"], [f"b{k}" for k in range(1, 8)] + ["BESS_PAR"],
                        "var", "value").withColumn("dataset", F.lit("all"))
    grids.write_covariates(long, root + "/cov")
    for rep in (0, 1):
        for year in (1996, 1997, 1998):
            W.run_upscaling(spark, root + "/cov", f"{root}/models/{exp}", root + "/cube", f"p_{rep}",
                            year, {"all": [f"b{k}" for k in range(1, 8)] + ["BESS_PAR"]}, rep)
    cube = grids.ensemble_scan(spark, root + "/cube", ["p_0", "p_1"])
    n = wide.where("year(time) BETWEEN 1996 AND 1998").count()
    assert cube.count() == 2 * n and cube.where("v IS NULL").count() == 0
    out = W.run_maps(cube, v.sea_mask, v.veg_mask)
    cells = cube.select("lat", "lon").distinct().count()
    assert {k: d.count() for k, d in out.items()} == dict.fromkeys(out, cells)
    # both repetitions used one model, so there is no spread
    assert {r["std_err"] for r in out["std_err"].collect()} <= {0.0, None}


def test_comparison(spark, v):
    from panelgrid.operators import grid
    out = W.run_comparison(v.ens, {"b": v.prod_b, "c": grid.wrapped(v.prod_c)}, v.sea_mask, v.veg_mask, 4)
    assert out["r2"].count() == 4 and out["share"].count() == 2
    assert 0 <= out["ranksum"].first()["p_value"] <= 1


def test_clean_panel(spark):
    raw = spark.createDataFrame(
        [("DE-Hte", 2001, 1, 10, 1.0, 2.0, 0.9), ("DE-Hte", 2001, 2, None, 1.0, 2.0, 0.9),
         ("x", 2001, 1, 17, 1.0, 2.0, 0.5), ("w", 2001, 1, 17, 1.0, 2.0, 0.9)],
        "site string, year int, month int, MODIS_LC int, NEE_CUT_REF double, GPP_NT_CUT_REF double, "
        "NEE_CUT_REF_QC double")
    sites = W.clean_sites(spark.createDataFrame(
        [("DE-Hte", None, 1.0), ("x", "CSH", 2.0), ("w", "WAT", 3.0)],
        "site string, IGBP string, LOCATION_ELEV double"))
    got = W.clean_panel(raw, sites).collect()
    assert [(r["site"], str(r["date"]), r["MODIS_LC"], r["IGBP"]) for r in got] == [
        ("DE-Hte", "2001-01-31", "GRA", "WET")]


def test_benchmark(spark, v):
    out = W.run_benchmark(v.bench, "block", "treatment", ["metric"])
    assert out["ranks_metric"].count() == 5 and out["friedman_metric"].first()["treatments"] == 5
