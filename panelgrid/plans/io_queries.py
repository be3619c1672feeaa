"""Write-and-read queries: results must survive the trip through files in the shared folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.functions.constants import COVARIATE_DATASETS
from panelgrid.operators import features, maps, scores, split, summarize
from panelgrid.plans.panel_queries import EVAL_SQL
from panelgrid.plans.registry import d, i, query, r
from panelgrid.plans.summary_queries import _ROWS, _fold_ctes, _labelled
from panelgrid.plans.views import sql
from panelgrid.session import scratch_path
from panelgrid.sources import experiments, grids, schemas, tables


@query("scan_panel", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')}
    FROM site_month_gaps"""))
def scan_panel(v):
    """Panel to CSV and back under an explicit schema; gaps stay NULL."""
    path = scratch_path(v.spark, "panel")
    tables.write_csv(v.site_month_gaps, path)
    schema = T.StructType([T.StructField("site", T.LongType()), T.StructField("date", T.DateType()),
                           T.StructField("gt", T.DoubleType()),
                           T.StructField("pred", T.DoubleType())])
    return tables.read_csv(v.spark, path, schema)


@query("scan_sites", sql("site_meta", f"""
    SELECT {i('site', 'site')}, class, sub, {r('elev', 'elev')} FROM site_meta"""))
def scan_sites(v):
    path = scratch_path(v.spark, "sites")
    tables.write_csv(v.site_meta, path, single_file=True)
    return tables.read_csv(v.spark, path, v.site_meta.schema)


@query("tagged_union", EVAL_SQL.replace("SELECT CAST(o.rep AS BIGINT) AS rep,", """
    SELECT 'run_' || o.rep AS exp_id, CASE WHEN o.rep % 2 = 0 THEN 'even' ELSE 'odd' END
           AS framework, o.rep || ' lines' AS variables,"""))
def tagged_union(v):
    """One metric table per run, read in one scan, with its tags."""
    m = scores.eval_metrics(v.site_month_rep, min_months=24)
    path = scratch_path(v.spark, "metrics")
    tables.write_metrics(m.select(F.concat(F.lit("run_"), "rep").alias("exp_id"),
                                  *schemas.METRIC_NAMES), path)
    odd = F.when(F.col("rep") % 2 == 0, "even").otherwise("odd")
    tags = v.lines.select("rep").distinct().select(
        F.concat(F.lit("run_"), "rep").alias("exp_id"), odd.alias("framework"),
        F.concat("rep", F.lit(" lines")).alias("variables"))
    return tables.read_tagged(v.spark, path, tags, schemas.METRICS)


@query("ensemble_scan", sql("ens", f"""
    SELECT {r('lat', 'lat')}, {r('lon', 'lon')}, {d('time', 'time')}, {i('rep', 'rep')},
           'exp_' || rep AS pred_id, {r('v', 'v')} FROM ens
    WHERE rep IN (1, 2, 5) AND time BETWEEN DATE '1996-03-31' AND DATE '1998-05-31'"""))
def ensemble_scan(v):
    path = scratch_path(v.spark, "ensemble")
    grids.write_ensemble(v.ens.withColumn("pred_id", F.concat(F.lit("exp_"), "rep")), path)
    wanted = ["exp_1", "exp_2", "exp_5", "exp_99"]
    return grids.ensemble_scan(v.spark, path, wanted, dt.date(1996, 3, 31), dt.date(1998, 5, 31))


def _covariates(v):
    monthly = v.lines.groupBy("site", "date").agg(
        (F.avg("l_quantity") / 7).alias("b1"), (F.avg("l_tax") / 7).alias("b2"),
        (F.avg("l_discount") / 7).alias("LST_Day"))
    yearly = v.lines.select("site", F.make_date(F.year("date"), F.lit(12), F.lit(31))
                            .alias("date")).distinct().withColumn(
        "IGBP", (1 + F.col("site") % 17).cast("double"))
    key = ["lat", "lon", "time"]
    layers = v.cells(monthly, "b1", "b2", "LST_Day").unpivot(
        key, ["b1", "b2", "LST_Day"], "var", "value")
    classes = v.cells(yearly, "IGBP").unpivot(key, ["IGBP"], "var", "value")
    dataset = (F.when(F.col("var") == "IGBP", "MCD12Q1").when(F.col("var") == "LST_Day", "MODIS_LST")
               .otherwise("MCD43C4v006"))
    return layers.unionByName(classes).withColumn("dataset", dataset)


@query("covariate_scan", sql("lines", f"""
    SELECT {r('lat', 'lat')}, {r('lon', 'lon')}, {d('time', 'time')}, {r('b1', 'b1')},
           {r('day', '"LST_Day"')}, {r('code', '"IGBP"')}
    FROM (SELECT lat, lon, time, avg(l_quantity) / 7 AS b1, avg(l_discount) / 7 AS day FROM c
          WHERE year(time) = 1997 GROUP BY ALL)
    FULL JOIN (SELECT lat, lon, last_day(make_date(1997, m, 1)) AS time, max(1 + site % 17) AS code
          FROM c, range(1, 13) t(m) WHERE year(time) = 1997 GROUP BY ALL) USING (lat, lon, time)""", {
    "c": """SELECT round(CAST(-47.5 + 5.0 * (site % 20) AS DOUBLE), 3) AS lat,
        round(CAST(-180.0 + 7.2 * floor(site / 20.0) AS DOUBLE), 3) AS lon, date AS time, site,
        l_quantity, l_discount FROM lines"""}))
def covariate_scan(v):
    """Variables a model needs for one year, side by side; the class layer is yearly."""
    path = scratch_path(v.spark, "covariates")
    grids.write_covariates(_covariates(v), path)
    wanted = features.needed_datasets(["b1", "LST_Day", "MODIS_LC_ENF"], COVARIATE_DATASETS)
    return grids.load_covariates(v.spark, path, wanted, 1997)


@query("mask_scan", sql("veg_mask", f"""
    SELECT {r('lat', 'lat')}, {r('lon', 'lon')}, {r('m', 'm')} FROM veg_mask"""))
def mask_scan(v):
    path = scratch_path(v.spark, "mask")
    raw = v.veg_mask.select(F.col("lat").alias("y"), F.col("lon").alias("x"),
                            F.col("m").alias("veg"), F.lit(0).alias("time"))
    raw.write.parquet(path)
    return grids.mask_scan(v.spark, path, "veg", {"y": "lat", "x": "lon"})


def _saved(v):
    """All repetitions as one experiment, saved below a fresh root."""
    root = scratch_path(v.spark, "experiments")
    folds = split.group_kfold(_labelled(v), "site", "label", k=5, seed=26)
    exp = F.concat(F.lit("20240101_"), "rep")
    p = v.site_month_rep.join(folds, "site").select(
        exp.alias("exp_id"), "rep", "fold", "site", "date", F.col("gt").alias("y"),
        F.col("pred").alias("y_pred"))
    roles = folds.select(
        F.lit("20240101_0").alias("exp_id"), F.lit(0).alias("rep"), "fold", "site",
        F.lit("test").alias("role"))
    experiments.save_experiment(root, p, roles)
    return root


@query("load_predictions", sql("site_month_rep", f"""
    SELECT '20240101_' || rep AS exp_id, {i('rep', 'rep')}, {i('fold', 'fold')},
           CAST(p.site AS VARCHAR) AS site, {d('date', 'date')}, {r('gt', 'y')}, {r('pred', 'y_pred')}
    FROM site_month_rep p JOIN folds f ON p.site = f.site""", _fold_ctes(_ROWS, 26, 5)))
def load_predictions(v):
    return experiments.load_predictions(v.spark, _saved(v), "20240101_")


@query("load_folds", sql("", f"""
    SELECT '20240101_0' AS exp_id, {i('0', 'rep')}, {i('fold', 'fold')},
           CAST(site AS VARCHAR) AS site, 'test' AS role FROM folds""", _fold_ctes(_ROWS, 26, 5)))
def load_folds(v):
    return experiments.load_folds(v.spark, _saved(v), "20240101_0")


@query("eval_saved", EVAL_SQL.replace("CAST(o.rep AS BIGINT) AS rep",
                                      "'20240101_' || o.rep AS exp_id"))
def eval_saved(v):
    """Scores straight from the saved predictions, one row per experiment repetition."""
    p = experiments.load_predictions(v.spark, _saved(v), "20240101_")
    return scores.eval_metrics(p, ["exp_id"], truth="y", pred="y_pred", min_months=24)


@query("scan_search", sql("search", f"""
    SELECT {i('rep', 'rep')}, {i('fold', 'fold')}, algorithm, {i('count(*)', 'n')},
           {r('min(score)', 'best')} FROM search GROUP BY ALL"""))
def scan_search(v):
    path = scratch_path(v.spark, "search")
    cols = [f.name for f in schemas.SEARCH.fields]
    tables.write_partitioned(v.search.withColumn("fold", F.col("fold").cast("int"))
                             .select(*cols), path, ["rep", "fold"])
    back = v.spark.read.schema(schemas.SEARCH).parquet(path)
    return back.groupBy("rep", "fold", "algorithm").agg(F.count(F.lit(1)).alias("n"),
                                                        F.min("score").alias("best"))


@query("learning_curve", sql("", f"""
    SELECT {i('rep', 'rep')}, {i('fold', 'fold')}, {r('seconds', 'seconds')}, {r('error', 'error')},
           {r('min(error) OVER (PARTITION BY rep, fold ORDER BY seconds)', 'best')}
    FROM (SELECT *, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY rep, fold) AS seconds
          FROM (SELECT user_id % 7 AS rep, event_id % 5 AS fold, ts, value / 7 AS error FROM events))"""))
def learning_curve(v):
    """Learning curves written per repetition and fold, read in one scan, and their best error so far."""
    path = scratch_path(v.spark, "curves")
    rows = v.table("events").select(
        (F.col("user_id") % 7).cast("int").alias("rep"), (F.col("event_id") % 5).cast("int").alias("fold"),
        F.col("ts").cast("timestamp").alias("ts"), (-F.col("value") / 7).alias("ensemble_optimization_score"))
    tables.write_partitioned(rows, path, ["rep", "fold"])
    return summarize.learning_curve(v.spark.read.schema(schemas.LEARNING_CURVE).parquet(path))


@query("class_error_table", sql("ens land_cover class_map", f"""
    SELECT merged AS key, {r('stddev_pop(v) / nullif(sqrt(count(v)) * abs(avg(v)), 0)', 'value')}
    FROM ens JOIN land_cover USING (lat, lon, time) JOIN class_map USING (code)
    WHERE merged IN ('ENF', 'EBF', 'DBF', 'MF', 'SH', 'SAV', 'GRA', 'WET', 'CRO')
    GROUP BY lat, lon, time, merged"""))
def class_error_table(v):
    """The long (key, value) error table, written by class and read back."""
    path = scratch_path(v.spark, "errors")
    errors = maps.rel_sem_by_class(v.ens, v.land_cover).select("key", "value")
    tables.write_partitioned(errors, path, ["key"])
    schema = T.StructType([T.StructField("key", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    return v.spark.read.schema(schema).parquet(path)


@query("resample_product", sql("daily", f"""
    SELECT {i('site', 'site')}, variable, {d('date', 'date')}, {r('value', 'value')} FROM (
        SELECT site, last_day(date) AS date, 'v' AS variable, avg(v) AS value FROM daily GROUP BY ALL)
    """))
def resample_product(v):
    """A daily product folder per month: read, averaged by month, in long form."""
    path = scratch_path(v.spark, "daily")
    daily = v.daily.withColumns({"year": F.year("date"), "month": F.month("date")})
    tables.write_partitioned(daily, path, ["year", "month"])
    from panelgrid.operators.grid import resample_monthly
    monthly = resample_monthly(v.spark.read.parquet(path), ["site"], ["v"], "date")
    return summarize.melt(monthly, ["site", "date"], ["v"])
