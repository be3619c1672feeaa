import datetime as dt

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid import config
from panelgrid.functions.constants import SCORED_CLASS_COLUMNS, VARIABLE_SETS
from panelgrid.operators import ml
from panelgrid.plans.views import Views
from panelgrid.sources import experiments, grids, schemas, tables

SF = "/root/testdata/sf0.001"


def test_csv_missing_values(spark, tmp_path):
    (tmp_path / "p.csv").write_text("site,date,v\na,2001-01-31,1.5\nb,2001-02-28,\nc,2001-03-31,nan\n"
                                    "d,2001-04-30,Inf\n")
    schema = T.StructType([T.StructField("site", T.StringType()), T.StructField("date", T.DateType()),
                           T.StructField("v", T.DoubleType())])
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "p.csv"), schema).collect()]
    assert got[0] == ("a", dt.date(2001, 1, 31), 1.5) and [g[2] for g in got[1:]] == [None] * 3


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "m")
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "exp_id string, x double")
    tables.write_metrics(m, path)
    tables.write_metrics(m.where("exp_id = 'a'").withColumn("x", F.lit(9.0)), path)
    got = {r["exp_id"]: r["x"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": 9.0, "b": 2.0}


def test_single_file(spark, tmp_path):
    df = spark.range(100).repartition(5)
    tables.write_csv(df, str(tmp_path / "one"), single_file=True)
    tables.write_csv(df, str(tmp_path / "many"))
    count = lambda p: len(list((tmp_path / p).glob("part-*")))
    assert count("one") == 1 and count("many") > 1


def test_experiment_tables(spark, tmp_path):
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    assert experiments.experiment_id("77", "3", now=now) == "2024050677_3"
    assert experiments.experiment_id(now=now) == "20240506070809"
    assert experiments.experiment_id("77", prepend_date=False, now=now) == "77"
    root = str(tmp_path)
    cfg = config.ExperimentConfig("x", "random_forest", "rs", {"n_iter": 3})
    experiments.register_run(spark, root, "2024050677_0", 0, now, 1.5, cfg)
    experiments.register_run(spark, root, "2024050677_1", 1, now, 2.5, cfg)
    assert experiments.load_runs(spark, root).count() == 2
    assert experiments.load_config(spark, root, "2024050677_1") == cfg and cfg.seed(3) == 29
    with pytest.raises(KeyError):
        experiments.load_config(spark, root, "none")
    p = spark.createDataFrame([("2024050677_0", 0, 1, "s", dt.date(2001, 1, 31), 1.0, 2.0),
                               ("2024050688_0", 0, 1, "s", dt.date(2001, 1, 31), 1.0, 2.0)],
                              schemas.PREDICTIONS)
    experiments.save_experiment(root, p)
    assert experiments.load_predictions(spark, root, "2024050677_").count() == 1
    assert experiments.load_predictions(spark, root).count() == 2


def test_matrix():
    m = config.experiment_matrix()
    assert len({c.name for c in m}) == len(m) == 17
    assert all(c.variable_set in VARIABLE_SETS and c.random_state == 26 for c in m)


def test_ensemble_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "e")
    v = Views(spark, SF)
    grids.write_ensemble(v.ens.withColumn("pred_id", F.concat(F.lit("7_"), "rep")), path)
    df = grids.ensemble_scan(spark, path, ["7_1", "7_2"], dt.date(1996, 2, 29), dt.date(1996, 12, 31))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "pred_id" in plan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(time" in plan
    want = v.ens.where("rep IN (1, 2) AND time BETWEEN '1996-02-29' AND '1996-12-31'")
    assert df.count() == want.count() > 0
    assert grids.repetition_ids("x", 2) == ["x_0", "x_1"]


def test_random_grid(spark):
    g = grids.random_grid(spark)
    a = g.agg(F.count("*"), F.min("v"), F.max("v"), F.countDistinct("lat"), F.countDistinct("lon")).first()
    assert a[0] == 20000 and 0 <= a[1] and a[2] <= 12 and a[3] == a[4] == 100


def test_candidate_pool(spark):
    pool = ml.candidate_pool(6)
    assert list(pool) == ["linear_1", "forest_1", "boosting_1", "glm_1", "linear_2", "forest_2"]
    assert len(ml.candidate_pool(24)) == 24


def test_forest_space():
    full = ml.forest_candidates(18, **{k: v for k, v in config.FOREST_PARAMS.items()
                                       if k not in ("min_samples_split", "scoring")})
    assert len(full) == 60 and {c["maxDepth"] for c in full} == {5, 10, 20, 30}
    assert all(c["featureSubsetStrategy"] == "15" for c in full)
    some = ml.forest_candidates(3, n_estimators=range(1, 50), n_iter=7, seed=1)
    assert len(some) == 7 == len({c["numTrees"] for c in some})
    assert some == ml.forest_candidates(3, n_estimators=range(1, 50), n_iter=7, seed=1)


def test_out_of_fold_predictions_cover_every_row_once(spark):
    v = Views(spark, SF)
    p = ml.cv_predictions(v.site_features, LinearRegression(), ["b4", "b5"], k=3)
    assert p.count() == v.site_features.count() == p.select("site", "date").distinct().count()
    assert p.groupBy("site").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_leaderboard_with_a_stack(spark):
    v = Views(spark, SF)
    cand = {k: e for k, e in ml.candidate_pool(24).items() if k in ("linear_1", "linear_2")}
    board, oof = ml.leaderboard(v.site_features, ["b4", "b5"], k=3, candidates=cand)
    names = {r["model"] for r in board.collect()}
    assert names == {"linear_1", "linear_2", "stack"}
    imp = ml.stack_importance(oof.where("model <> 'stack'"), list(cand)).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert {r["family"] for r in imp} == {"linear"}
    assert {r["count"] for r in oof.groupBy("model").count().collect()} == {v.site_features.count()}


def test_score_grid_classes(spark):
    """Excluded classes stay as NULL; a missing class or feature is scored."""
    train = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    model = ml.pipeline(LinearRegression(), ["x"]).fit(train)
    cells = spark.createDataFrame(
        [(0.0, 1, 1.0), (1.0, 17, 1.0), (2.0, 15, 1.0), (3.0, 16, 1.0), (4.0, 0, 1.0), (5.0, None, 1.0),
         (6.0, 5, None), (7.0, 5, float("inf"))], "lat double, code int, x double")
    out = ml.score_grid(cells, model, "code", SCORED_CLASS_COLUMNS, keys=["lat"])
    got = {r["lat"]: r["v"] for r in out.collect()}
    assert [got[float(k)] is None for k in range(8)] == [False, True, True, True, True, False, False, False]
    assert got[0.0] == pytest.approx(2.0) and ml.feature_names(model) == ["x"]
