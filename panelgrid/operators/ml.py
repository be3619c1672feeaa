"""Models on shared folds: search, cross-validated predictions, bootstrap, grid scoring.

Models are Spark ML pipelines, so every fit is distributed and the feature list travels with the
saved model. Folds are drawn per site; a fold is a filter on a column, never a list of rows.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import (GBTRegressor, GeneralizedLinearRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.columns import ratio, recode, sanitize, uniform
from panelgrid.functions.constants import PIXEL_CODE_TO_CLASS, UNSCORED_CLASSES
from panelgrid.operators import split
from panelgrid.operators.features import one_hot
from panelgrid.operators.scores import r2, rmse
from panelgrid.session import pin

# Ridge on the predictions of the candidates; built on use, as Spark needs a session first.
def _meta() -> LinearRegression:
    return LinearRegression(regParam=0.01, elasticNetParam=0.0)


# Spark's trees stop at this depth; an unlimited depth means this one.
DEEPEST = 30


def pipeline(regressor: Estimator, features: Sequence[str], label: str = "y",
             out: str = "prediction") -> Pipeline:
    """Fill, assemble and regress the listed features.

    A missing feature takes the mean of the rows the pipeline is fitted on, so no row is dropped in
    fitting and every row gets a prediction. Helper columns carry the name of ``out``, so pipelines
    with different outputs can follow one another.
    """
    regressor = regressor.copy()
    own = "" if out == "prediction" else f"_{out}"
    regressor.setParams(featuresCol=f"_features{own}", labelCol=label, predictionCol=out)
    filled = [f"_filled{own}_{n}" for n in range(len(features))]
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled, strategy="mean"),
                            VectorAssembler(inputCols=filled, outputCol=f"_features{own}"), regressor])


def _leaves(stages: Iterable) -> list:
    return [x for s in stages for x in (_leaves(s.stages) if isinstance(s, PipelineModel) else [s])]


def feature_names(model: PipelineModel) -> list[str]:
    """Columns the model reads: inputs of its stages that no earlier stage has made."""
    made, names = set(), []
    for stage in _leaves(model.stages):
        if stage.hasParam("inputCols"):
            names += [c for c in stage.getInputCols() if c not in made and c not in names]
        for p in ("outputCols", "outputCol", "predictionCol"):
            if stage.hasParam(p) and stage.isDefined(p):
                v = stage.getOrDefault(p)
                made.update([v] if isinstance(v, str) else v)
    return names


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- candidates --------------------------------------------------------------------------

def forest_candidates(n_features: int, n_estimators: Sequence[int] = (200,),
                      max_depth: Sequence[int | None] = (15,),
                      min_samples_leaf: Sequence[int] = (5,), max_features: int = 15,
                      n_iter: int = 5, seed: int = 26, max_bins: int = 32) -> list[dict]:
    """A seeded sample of the forest search space, without repeats.

    A split-size limit has no counterpart in Spark's trees and is not searched.
    """
    space = list(itertools.product(n_estimators, max_depth, min_samples_leaf))
    picked = space if len(space) <= n_iter else random.Random(seed).sample(space, n_iter)
    share = min(max_features, n_features)
    return [{"numTrees": t, "maxDepth": DEEPEST if d is None else min(d, DEEPEST),
             "minInstancesPerNode": leaf, "featureSubsetStrategy": str(share),
             "maxBins": max_bins, "seed": seed} for t, d, leaf in picked]


def candidate_pool(budget: int = 12, seed: int = 26) -> dict[str, Estimator]:
    """The first ``budget`` settings of the leaderboard, families taking turns.

    Names are ``<family>_<number>``; every family starts with its plainest setting.
    """
    families = {
        "linear": [LinearRegression(regParam=p, elasticNetParam=e)
                   for p, e in ((0.0, 0.0), (0.01, 0.0), (0.1, 0.0), (0.01, 1.0), (0.1, 1.0))],
        "forest": [RandomForestRegressor(numTrees=t, maxDepth=d, seed=seed)
                   for t in (20, 50, 100, 200) for d in (5, 10, 15)],
        "boosting": [GBTRegressor(maxIter=n, maxDepth=d, seed=seed)
                     for n in (20, 50, 100) for d in (3, 5)],
        "glm": [GeneralizedLinearRegression(family="gaussian", link=link, regParam=p)
                for link in ("identity",) for p in (0.0, 0.01, 0.1)],
    }
    turns = itertools.zip_longest(*[[(f"{f}_{n}", e) for n, e in enumerate(es, 1)]
                                    for f, es in families.items()])
    return dict([c for turn in turns for c in turn if c is not None][:budget])


# ---- cross-validation --------------------------------------------------------------------

def training_table(df: DataFrame, features: Sequence[str], y: str, strat: str | None,
                   keys: Sequence[str] = ("site", "date")) -> DataFrame:
    """Rows with a target, pinned: every fold and candidate reads them again.

    Rows with a missing feature or label stay; the pipeline fills features, folds know the label.
    """
    cols = [*keys, *features, F.col(y).cast("double").alias("y"),
            (F.col(strat) if strat else F.lit("all")).cast("string").alias("strat")]
    return pin(sanitize(df.select(*cols)).dropna(subset=["y"]), "training")


def _predict_fold(est: Pipeline, rows: DataFrame, fold: int, name: str) -> DataFrame:
    return _scored(est.fit(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold), name)


def _scored(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).select("site", "date", "fold", "y", F.col("prediction").alias("y_pred"),
                                        F.lit(name).alias("model"))


def cv_predictions(df: DataFrame, make: Callable[[DataFrame], Estimator] | Estimator,
                   features: Sequence[str], y: str = "gt", strat: str | None = None, k: int = 5,
                   seed: int = 26) -> DataFrame:
    """Out-of-fold predictions: one distributed fit per fold.

    ``make`` is an estimator, or a function that returns a tuned one from the training rows of a
    fold.
    """
    table = training_table(df, features, y, strat)
    folds = split.group_kfold(table, "site", "strat", k, seed)
    rows = pin(table.join(folds, "site"), "folds")
    parts = []
    for f in range(k):
        est = make if isinstance(make, Estimator) else make(rows.where(F.col("fold") != f))
        parts.append(_predict_fold(pipeline(est, features), rows, f, type(est).__name__))
    return reduce(DataFrame.unionByName, parts)


def cv_of(df: DataFrame, fit: Callable[[DataFrame], PipelineModel], features: Sequence[str], y: str,
          strat: str | None = None, k: int = 5, seed: int = 26, name: str = "model") -> DataFrame:
    """Out-of-fold predictions of whatever ``fit`` makes of the training rows of each fold."""
    table = training_table(df, features, y, strat)
    folds = split.group_kfold(table, "site", "strat", k, seed)
    rows = pin(table.join(folds, "site"), "folds")
    return reduce(DataFrame.unionByName, [
        _scored(fit(rows.where(F.col("fold") != f).drop("fold")), rows.where(F.col("fold") == f), name)
        for f in range(k)])


def fold_scores(predictions: DataFrame) -> DataFrame:
    """R2 and RMSE per fold."""
    a = r2(predictions, "y", "y_pred", ["fold"])
    return a.join(rmse(predictions, "y", "y_pred", ["fold"]), "fold")


def search_forest(train: DataFrame, features: Sequence[str], k: int = 5, seed: int = 26,
                  parallelism: int = 2, **space) -> tuple[RandomForestRegressor, DataFrame]:
    """Random search over the forest space on grouped inner folds; the winner and all scores.

    ``train`` has site, strat, y and the features. Inner folds use the fold column of Spark's
    cross-validator, so tuning respects sites.
    """
    folds = split.group_kfold(train.drop("fold"), "site", "strat", k, seed)
    rows = train.drop("fold").join(folds, "site").withColumn("_fold", F.col("fold").cast("int"))
    base = RandomForestRegressor(featuresCol="_features", labelCol="y")
    grid = [{base.getParam(p): v for p, v in c.items()}
            for c in forest_candidates(len(features), seed=seed, **space)]
    cv = CrossValidator(estimator=pipeline(base, features), estimatorParamMaps=grid, numFolds=k, foldCol="_fold",
                        evaluator=RegressionEvaluator(labelCol="y", metricName="rmse"),
                        parallelism=parallelism)
    fitted = cv.fit(rows.select(*features, "y", "_fold"))
    best = min(range(len(grid)), key=lambda n: fitted.avgMetrics[n])
    scores = train.sparkSession.createDataFrame(
        [(n, str({p.name: v for p, v in g.items()}), float(m))
         for n, (g, m) in enumerate(zip(grid, fitted.avgMetrics))],
        "candidate int, params string, rmse double")
    return base.copy(grid[best]), scores


# ---- tuning inside the training rows -----------------------------------------------------

#: A candidate is an estimator, or an estimator with features of its own.
Candidates = Mapping[str, Estimator | tuple[Estimator, Sequence[str]]]


def _candidate(candidates: Candidates, name: str, features: Sequence[str],
               out: str = "prediction") -> Pipeline:
    c = candidates[name]
    est, own = (c, features) if isinstance(c, Estimator) else c
    return pipeline(est, own, out=out)


def rungs(n: int) -> list[tuple[int, float]]:
    """(candidates, share of the sites) of each round: half of them go on, with twice the sites."""
    rounds = math.ceil(math.log2(n)) if n > 1 else 0
    return [(math.ceil(n / 2 ** j), 2.0 ** (j + 1 - rounds)) for j in range(rounds)]


def tune(train: DataFrame, candidates: Candidates, features: Sequence[str], k: int = 5,
         seed: int = 26, parallelism: int = 8) -> tuple[str, list[dict]]:
    """Successive halving on grouped inner folds: the winner's name, and every score on the way.

    ``train`` has site, strat, y and the features. All candidates are scored on a hashed share of the
    sites, each fitted on the other inner folds; the better half meets again on twice the sites, and the
    last round sees them all. The score is the RMSE over all out-of-fold rows of the round. The fits of
    a round run side by side; only their sums of squares reach the driver. A tie goes to the name that
    sorts first.
    """
    if len(candidates) == 1:
        return next(iter(candidates)), []
    base = train.drop("fold")
    folds = split.group_kfold(base, "site", "strat", k, seed)
    rows = pin(base.join(folds, "site").withColumn("_draw", uniform(seed, "site")), "inner")
    alive, log = sorted(candidates), []
    with ThreadPool(parallelism) as pool:
        for count, share in rungs(len(candidates)):
            part = rows.where(F.col("_draw") < share)

            there = [r.fold for r in part.select("fold").distinct().collect()]

            def errors(job, part=part):
                name, fold = job
                model = _candidate(candidates, name, features).fit(part.where(F.col("fold") != fold))
                scored = model.transform(part.where(F.col("fold") == fold))
                r = scored.agg(F.sum(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0))), F.count("y")).first()
                return name, r[0], r[1]

            # a share of one fold's sites only says nothing yet
            jobs = [(n, f) for n in alive for f in there if len(there) > 1]
            found = pool.map(errors, jobs, chunksize=1)
            sums = {n: [sum(r[i] for r in found if r[0] == n) for i in (1, 2)] for n in alive}
            score = {n: math.sqrt(s / c) if c else math.inf for n, (s, c) in sums.items()}
            kept = sorted(alive, key=lambda n: (score[n], n))[:math.ceil(count / 2)]
            log += [{"share": share, "model": n, "rmse": score[n], "kept": n in kept} for n in alive]
            alive = kept
    return alive[0], log


def nested_cv(df: DataFrame, candidates: Candidates, features: Sequence[str], y: str = "gt",
              strat: str | None = None, k: int = 5, inner_k: int = 5, seed: int = 26,
              parallelism: int = 8) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of a model that each outer fold chooses without seeing its own sites.

    For each outer fold the candidates are tuned on its training rows alone (:func:`tune`), the winner is
    fitted on all of these and predicts the fold. Returns the predictions and the scores of the tuning
    (fold, share, model, rmse, kept).
    """
    table = training_table(df, features, y, strat)
    folds = split.group_kfold(table, "site", "strat", k, seed)
    rows = pin(table.join(folds, "site"), "folds")
    parts, log = [], []
    for f in range(k):
        train = rows.where(F.col("fold") != f)
        name, scores = tune(train, candidates, features, inner_k, seed, parallelism)
        log += [(f, s["share"], s["model"], s["rmse"], s["kept"]) for s in scores]
        parts.append(_predict_fold(_candidate(candidates, name, features), rows, f, name))
    scores = df.sparkSession.createDataFrame(
        log, "fold int, share double, model string, rmse double, kept boolean")
    return reduce(DataFrame.unionByName, parts), scores


# ---- stacks ------------------------------------------------------------------------------

def bagged_layer(rows: DataFrame, candidates: Candidates, features: Sequence[str], layer: int = 1,
                 k: int = 5, bags: int = 1, seed: int = 26, parallelism: int = 8) -> DataFrame:
    """``rows`` with a column ``<candidate>_<layer>``: its out-of-fold prediction, averaged over bags.

    Each bag draws folds of its own; a row is always predicted by models that have not seen its
    site. ``rows`` has ``_row``, a number of its own for each row.
    """
    columns = {n: f"{n}_{layer}" for n in candidates}
    parts = []
    for bag in range(bags):
        folds = split.group_kfold(rows, "site", "strat", k, seed + bag)
        here = pin(rows.drop("fold").join(folds, "site"), "bag")

        def fitted(job, here=here):
            name, fold = job
            model = _candidate(candidates, name, features).fit(here.where(F.col("fold") != fold))
            return model.transform(here.where(F.col("fold") == fold)).select(
                "_row", F.lit(name).alias("model"), "prediction")

        with ThreadPool(parallelism) as pool:
            parts += pool.map(fitted, [(n, f) for n in candidates for f in range(k)], chunksize=1)
    wide = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(*[
        F.avg(F.when(F.col("model") == n, F.col("prediction"))).alias(c) for n, c in columns.items()])
    return pin(rows.join(wide, "_row"), "layer")


def fit_stack(train: DataFrame, candidates: Candidates, features: Sequence[str], layers: int = 1,
              k: int = 5, bags: int = 1, seed: int = 26, parallelism: int = 8) -> PipelineModel:
    """Layers of candidates under a linear meta model, as one pipeline.

    A layer learns from the features and the out-of-fold predictions of the layer below; the meta model
    weighs those of the last. What predicts new rows is each candidate fitted on all training rows.
    """
    rows = pin(train.withColumn("_row", F.monotonically_increasing_id()), "stack-rows")
    known, stages = list(features), []
    for layer in range(1, layers + 1):
        names = [f"{n}_{layer}" for n in candidates]
        with ThreadPool(parallelism) as pool:
            stages += pool.map(lambda n: _candidate(candidates, n, known, f"{n}_{layer}").fit(rows),
                               list(candidates), chunksize=1)
        rows = bagged_layer(rows, candidates, known, layer, k, bags, seed, parallelism)
        known = [*features, *names]
    return PipelineModel([*stages, pipeline(_meta(), names).fit(rows)])


def stack_layers(df: DataFrame, candidates: Candidates, features: Sequence[str], y: str = "gt",
                 strat: str | None = None, layers: int = 3, bags: int = 20, k: int = 5,
                 outer_k: int = 5, seed: int = 26, parallelism: int = 8) -> DataFrame:
    """Out-of-fold predictions of a layered stack; every outer fold builds its own without its sites."""
    table = training_table(df, features, y, strat)
    folds = split.group_kfold(table, "site", "strat", outer_k, seed)
    rows = pin(table.join(folds, "site"), "folds")
    parts = []
    for f in range(outer_k):
        model = fit_stack(rows.where(F.col("fold") != f).drop("fold"), candidates, features, layers, k,
                          bags, seed, parallelism)
        parts.append(_scored(model, rows.where(F.col("fold") == f), "stack"))
    return reduce(DataFrame.unionByName, parts)


def bootstrap_predictions(df: DataFrame, estimator: Estimator, features: Sequence[str],
                          y: str = "gt", size: float = 0.8, reps: Sequence[int] = (0,),
                          base_seed: int = 26, parallelism: int = 8) -> DataFrame:
    """Fit on the sites in the bag, predict the others, for each repetition.

    The rows are stored once; each repetition joins the roles of its sites to them. Fits run side by
    side.
    """
    table = training_table(df, features, y, None)
    roles = pin(split.group_bootstrap(table, "site", size, max(reps) + 1, base_seed)
                .where(F.col("rep").isin(list(reps))), "roles")

    def one(rep):
        mine = table.join(roles.where(F.col("rep") == rep), "site")
        model = pipeline(estimator, features).fit(mine.where("role = 'train'"))
        return model.transform(mine.where("role = 'test'")).select(
            "rep", "site", "date", "y", F.col("prediction").alias("y_pred"))

    with ThreadPool(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, reps, chunksize=1))


def leaderboard(df: DataFrame, features: Sequence[str], y: str = "gt", strat: str | None = None,
                k: int = 5, seed: int = 26, candidates: Candidates | None = None,
                stack: bool = True, parallelism: int = 8) -> tuple[DataFrame, DataFrame]:
    """Candidates on the same folds, plus a linear stack of their out-of-fold predictions.

    The ranking compares candidates; a score of the best one is too good, as the same folds chose it.
    For an honest score use :func:`nested_cv`.

    Returns the ranking and all out-of-fold predictions. The stack is itself cross-fitted on the
    folds, so it is scored on sites it has not seen.
    """
    candidates = candidates or candidate_pool(seed=seed)
    table = training_table(df, features, y, strat)
    folds = split.group_kfold(table, "site", "strat", k, seed)
    rows = pin(table.join(folds, "site"), "folds")
    with ThreadPool(parallelism) as pool:
        parts = pool.map(lambda job: _predict_fold(_candidate(candidates, job[0], features), rows, job[1],
                                                   job[0]),
                         [(name, f) for name in candidates for f in range(k)], chunksize=1)
    oof = pin(reduce(DataFrame.unionByName, parts), "oof")
    if stack:
        wide = pin(_side_by_side(oof, list(candidates)), "stack")
        parts = [_predict_fold(pipeline(_meta(), list(candidates)), wide, f, "stack")
                 for f in range(k)]
        oof = reduce(DataFrame.unionByName, [oof, *parts])
    board = r2(oof, "y", "y_pred", ["model"]).join(rmse(oof, "y", "y_pred", ["model"]), "model")
    return board, oof


def _side_by_side(oof: DataFrame, names: Sequence[str]) -> DataFrame:
    return oof.groupBy("site", "date", "fold").agg(
        F.max("y").alias("y"),
        *[F.max(F.when(F.col("model") == n, F.col("y_pred"))).alias(n) for n in names])


def stack_importance(oof: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of each candidate in the stack: |weight| times the spread of its predictions."""
    wide = pin(_side_by_side(oof, names), "stack")
    weights = pipeline(_meta(), names).fit(wide).stages[-1].coefficients
    spread = wide.agg(*[F.stddev_pop(n).alias(n) for n in names])
    parts = [F.struct(F.lit(n).alias("base_model"), (F.col(n) * abs(float(w))).alias("raw"))
             for n, w in zip(names, weights)]
    total = reduce(lambda a, b: a + b, [F.col(n) * abs(float(w)) for n, w in zip(names, weights)])
    return spread.select(total.alias("total"), F.explode(F.array(*parts)).alias("p")).select(
        "p.base_model", F.element_at(F.split("p.base_model", "_"), 1).alias("family"),
        ratio("p.raw", "total").alias("importance"))


# ---- grid scoring ------------------------------------------------------------------------

def score_grid(df: DataFrame, model: PipelineModel, code: str | None = None,
               classes: Sequence[str] = (), class_column: str = "MODIS_LC",
               keys: Sequence[str] = ("lat", "lon", "time"), out: str = "v") -> DataFrame:
    """Predict every cell; excluded classes come back as NULL, missing features are filled as in
    training.

    Codes become classes, classes become the one-hot columns the model was trained with, and
    every input cell is kept in place, so nothing has to be joined back.
    """
    names = feature_names(model)
    df = sanitize(df)
    eligible = F.lit(True)
    if code is not None:
        df = df.withColumn(class_column, recode(F.col(code).cast("int"), PIXEL_CODE_TO_CLASS))
        df = df.withColumn("_excluded", F.coalesce(
            F.col(class_column).isin(UNSCORED_CLASSES), F.lit(False)))
        eligible = ~F.col("_excluded")
        df = one_hot(df, class_column, classes)
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(0.0))
    scored = model.transform(df.withColumn("_ok", eligible).withColumns(
        {n: F.col(f"`{n}`").cast("double") for n in names}))
    return scored.select(*keys, F.when(F.col("_ok"), F.col("prediction")).alias(out))
