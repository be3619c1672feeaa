"""End-to-end runs: cross-validation, bootstrap, upscaling, maps, product comparison.

Each is a short chain of operators over tables. A repetition is a value in a column or an
argument, not a separate process.
"""

from __future__ import annotations

import datetime as dt
import os
import time
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.config import ExperimentConfig
from panelgrid.functions.constants import (CODE_TO_CLASS, SCORED_CLASS_COLUMNS,
                                           SITE_CLASS_PATCHES, SITE_CODE_TO_CLASS, VARIABLE_SETS)
from panelgrid.operators import (clean, features, grid, maps, ml, panel, sample, scores, split,
                                 stats)
from panelgrid.session import pin
from panelgrid.sources import experiments, grids, tables

CLASS_COLUMN = "MODIS_LC"


def clean_sites(raw: DataFrame) -> DataFrame:
    """Site table with merged classes, corrected records and readable names."""
    s = clean.recode_column(raw, "IGBP", SITE_CODE_TO_CLASS, keep_unknown=True)
    return clean.apply_patches(s, "site", "IGBP", SITE_CLASS_PATCHES)


def clean_panel(raw: DataFrame, sites: DataFrame, flux: str = "NEE_CUT_REF",
                value: str = "GPP_NT_CUT_REF", qc: str = "NEE_CUT_REF_QC") -> DataFrame:
    """Raw monthly records to the analysis panel: dates, classes, site attributes, filters."""
    p = clean.with_month_end(raw)
    p = clean.recode_column(p, CLASS_COLUMN, CODE_TO_CLASS, keep_unknown=False)
    attributes = [c for c in ("IGBP", "LOCATION_ELEV", "koppen_main") if c in sites.columns]
    p = clean.join_site_meta(p, sites, attributes)
    p = panel.drop_empty_dates(p, CLASS_COLUMN)
    return clean.quality_filter(p, flux, value, qc, "IGBP")


def _feature_columns(config: ExperimentConfig, classes: Sequence[str] | None) -> list[str]:
    cols = [c for c in VARIABLE_SETS[config.variable_set] if c != CLASS_COLUMN]
    if CLASS_COLUMN in VARIABLE_SETS[config.variable_set]:
        cols += [f"{CLASS_COLUMN}_{c}" for c in classes or SCORED_CLASS_COLUMNS]
    return cols


def model_table(df: DataFrame, config: ExperimentConfig, target: str,
                classes: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Feature table of an experiment and the names of its features.

    For the forest, gaps are filled within sites first, as the study does; what is still missing is
    filled by the model.
    """
    names = VARIABLE_SETS[config.variable_set]
    strat = f"target_{CLASS_COLUMN}" if CLASS_COLUMN in names else CLASS_COLUMN
    t = features.feature_set(df, config.variable_set, target=[target, CLASS_COLUMN],
                             encode=[CLASS_COLUMN],
                             classes={CLASS_COLUMN: list(classes or SCORED_CLASS_COLUMNS)})
    cols = _feature_columns(config, classes)
    if config.model == "random_forest":
        numeric = [c for c in cols if not c.startswith(f"{CLASS_COLUMN}_") and c != "year"]
        t = panel.gap_fill(t, [*numeric, target])
    return t.withColumnRenamed(strat, "strat_class"), cols


def _tuned(config: ExperimentConfig, cols: Sequence[str], seed: int):
    p = config.model_params
    space = {k: p[k] for k in ("n_estimators", "max_depth", "min_samples_leaf", "max_features",
                               "n_iter") if k in p}

    def make(train: DataFrame) -> RandomForestRegressor:
        return ml.search_forest(train, cols, config.n_folds_tuning, seed, **space)[0]
    return make


def fit_configured(train: DataFrame, config: ExperimentConfig, cols: Sequence[str],
                   seed: int) -> PipelineModel:
    """The configured model, tuned and fitted on training rows alone.

    ``train`` has site, strat, y and the features. Forests are searched, a leaderboard keeps its best
    candidate by successive halving, a stack weighs all candidates; inner folds are grouped by site.
    """
    p = config.model_params
    if config.model == "random_forest":
        return ml.pipeline(_tuned(config, cols, seed)(train), cols).fit(train)
    pool = ml.candidate_pool(p.get("candidates", 12), seed)
    if config.model == "stacked":
        return ml.fit_stack(train, pool, cols, p.get("layers", 1), config.n_folds_tuning,
                            p.get("bags", 1), seed)
    best, _ = ml.tune(train, pool, cols, config.n_folds_tuning, seed)
    return ml.pipeline(pool[best], cols).fit(train)


def run_cv(spark: SparkSession, df: DataFrame, config: ExperimentConfig, root: str, job: str,
           rep: int = 0, target: str = "GPP_NT_CUT_REF") -> str:
    """Cross-validate one repetition and save predictions, folds and the run; returns its id.

    Whatever the model, it is tuned inside the training sites of each fold; the sites of the fold
    only ever get predicted.
    """
    started, t0 = dt.datetime.now(), time.time()
    seed = config.seed(rep)
    exp_id = experiments.experiment_id(job, str(rep), now=started)
    table, cols = model_table(df, config, target)
    table = pin(table, "features")
    p = ml.cv_of(table, lambda train: fit_configured(train, config, cols, seed), cols, target,
                 "strat_class", config.n_folds_cv, seed, config.model)
    p = p.withColumns({"exp_id": F.lit(exp_id), "rep": F.lit(rep)})
    folds = p.select("exp_id", "rep", "fold", "site", F.lit("test").alias("role")).distinct()
    experiments.save_experiment(root, p, folds, table.withColumn("exp_id", F.lit(exp_id)))
    experiments.register_run(spark, root, exp_id, rep, started, time.time() - t0, config)
    return exp_id


def run_bootstrap(spark: SparkSession, df: DataFrame, config: ExperimentConfig, root: str,
                  job: str, rep: int = 0, target: str = "GPP_NT_CUT_REF") -> str:
    """Fit the configured model on the sites in the bag; save it and its out-of-bag predictions."""
    started, t0 = dt.datetime.now(), time.time()
    exp_id = experiments.experiment_id(job, str(rep), now=started)
    table, cols = model_table(df, config, target)
    rows = ml.training_table(table, cols, target, "strat_class")
    roles = split.group_bootstrap(rows, "site", config.bootstrap_size, 1, config.seed(rep))
    rows = pin(rows.join(roles.drop("rep"), "site"), "bootstrap")
    model = fit_configured(rows.where("role = 'train'").drop("role"), config, cols, config.seed(rep))
    ml.save_model(model, os.path.join(root, "models", exp_id))
    out = model.transform(rows.where("role = 'test'")).select(
        F.lit(exp_id).alias("exp_id"), F.lit(rep).alias("rep"), F.lit(0).alias("fold"), "site",
        "date", "y", F.col("prediction").alias("y_pred"))
    folds = roles.select(F.lit(exp_id).alias("exp_id"), F.lit(rep).alias("rep"),
                         F.lit(0).alias("fold"), "site", "role")
    experiments.save_experiment(root, out, folds)
    experiments.register_run(spark, root, exp_id, rep, started, time.time() - t0, config)
    return exp_id


def evaluate(spark: SparkSession, root: str, prefix: str, min_months: int = 0,
             sites: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores per repetition of an experiment, and per site with its class; both are saved."""
    p = experiments.load_predictions(spark, root, prefix)
    args = dict(keys=["exp_id"], truth="y", pred="y_pred", min_months=min_months)
    out = {"metrics": scores.eval_metrics(p, **args)}
    if sites is not None:
        out["metrics_by_class"] = scores.eval_by_class(p, sites, "IGBP", **args)
    for name, df in out.items():
        tables.write_partitioned(df, os.path.join(root, name), ["exp_id"])
    return {n: spark.read.parquet(os.path.join(root, n)) for n in out}


def run_upscaling(spark: SparkSession, covariates: str, model_path: str, out: str, pred_id: str,
                  year: int, datasets: Mapping[str, Sequence[str]], rep: int = 0,
                  stride: int = 1) -> None:
    """Score the covariate grid of a year with a saved model and write the cube."""
    model = ml.load_model(model_path)
    names = ml.feature_names(model)
    wanted = features.needed_datasets(names, datasets)
    if "year" in names:
        wanted = {d: [v for v in vs if v != "year"] for d, vs in wanted.items()}
    cells = grids.load_covariates(spark, covariates, wanted, year)
    if stride > 1:
        cells = grid.grid_stride(cells, stride)
    back = {v: k for k, v in features.FEATURE_ALIASES.items() if k != CLASS_COLUMN}
    cells = cells.withColumnsRenamed(back).withColumn("year", F.lit(float(year)))
    code = "IGBP" if "IGBP" in cells.columns else None
    classes = [n.removeprefix(f"{CLASS_COLUMN}_") for n in names
               if n.startswith(f"{CLASS_COLUMN}_")]
    scored = ml.score_grid(cells, model, code, classes)
    grids.write_ensemble(scored.withColumns({"rep": F.lit(rep), "pred_id": F.lit(pred_id)}), out)


def run_maps(ensemble: DataFrame, land: DataFrame | None = None,
             vegetation: DataFrame | None = None, monthly: bool = True) -> dict[str, DataFrame]:
    """All maps of an ensemble. The mean is taken without masks, the others within them."""
    if monthly:
        ensemble = grid.resample_monthly(ensemble, ["lat", "lon", "rep"], ["v"])
    inside = grid.apply_mask(ensemble, ["v"], land=land, vegetation=vegetation, sea_value=None,
                             bare_value=None)
    return {"mean": maps.map_mean(ensemble), "msc": maps.map_msc(inside),
            "trend": maps.map_trend(inside), "anomalies": maps.map_anomalies(inside),
            "std_err": maps.map_err(inside), "std_err_pct": maps.map_err(inside, relative=True)}


def run_comparison(ensemble: DataFrame, products: Mapping[str, DataFrame], land: DataFrame,
                   vegetation: DataFrame, n: int = 10_000, seed: int = 0) -> dict[str, DataFrame]:
    """R2 of the ensemble against each product at area-weighted locations, and their rank test."""
    inside = grid.combine_masks(ensemble, land, vegetation).where("inside")
    where = sample.area_sample(inside, n, seed)
    monthly = {k: grid.resample_monthly(p, ["lat", "lon"], ["v"]) for k, p in products.items()}
    series = sample.compare_at_locations(where, {"ours": ensemble, **monthly})
    r2 = pin(scores.location_r2(series, list(products), "ours"), "location_r2")
    out = {"r2": r2}
    names = [f"r2_{k}" for k in products]
    both = r2.dropna(subset=names)
    out["share"] = scores.share_above(both, names, 0.8)
    if len(names) == 2:
        out["ranksum"] = stats.ranksum(both, *names)
    return out


def run_benchmark(metrics: DataFrame, block: str, treatment: str,
                  columns: Sequence[str]) -> dict[str, DataFrame]:
    """Friedman test and mean ranks of the treatments for each metric column."""
    out = {}
    for c in columns:
        out[f"friedman_{c}"] = stats.friedman(metrics, block, treatment, c)
        out[f"ranks_{c}"] = stats.mean_ranks(metrics, block, treatment, c)
    return out
