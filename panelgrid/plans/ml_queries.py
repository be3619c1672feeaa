"""Model queries. A one-feature linear model has a closed form, so SQL can check the folds,
the bootstrap and the grid scorer; tree models are checked for rows only."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from panelgrid.functions.columns import recode
from panelgrid.functions.constants import CODE_TO_CLASS, SCORED_CLASS_COLUMNS
from panelgrid.operators import ml
from panelgrid.plans.registry import ORACLE, d, i, query, r
from panelgrid.plans.summary_queries import _fold_ctes
from panelgrid.plans.views import sql
from panelgrid.session import pin, scratch_path

TREES = ["b4", "b5", "b6", "b7", "BESS-PAR"]

_ALL = "SELECT site AS grp, 'all' AS label FROM site_features"
_CV = {
    **_fold_ctes(_ALL, 26, 5),
    "rows": "SELECT s.site, date, b4, gt, fold FROM site_features s JOIN folds f ON s.site = f.site",
    "fit": """SELECT t.fold, regr_slope(gt, b4) AS b, regr_intercept(gt, b4) AS a
              FROM (SELECT DISTINCT fold FROM rows) t JOIN rows x ON x.fold <> t.fold
              GROUP BY t.fold""",
    "oof": "SELECT x.*, a + b * b4 AS p FROM rows x JOIN fit f ON x.fold = f.fold",
}


@query("cv_predictions", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {i('fold', 'fold')}, {r('gt', 'y')},
           {r('p', 'y_pred')}, 'LinearRegression' AS model FROM oof""", _CV))
def cv_predictions(v):
    return ml.cv_predictions(v.site_features, LinearRegression(), ["b4"])


@query("cv_scores", sql("site_features", f"""
    SELECT {i('fold', 'fold')}, {r('1 - sum((gt - p) ** 2) / sum((gt - m) ** 2)', 'r2')},
           {r('sqrt(avg((gt - p) ** 2))', 'rmse')}
    FROM (SELECT *, avg(gt) OVER (PARTITION BY fold) AS m FROM oof) GROUP BY fold""", _CV))
def cv_scores(v):
    return ml.fold_scores(ml.cv_predictions(v.site_features, LinearRegression(), ["b4"]))


@query("bootstrap_predictions", sql("site_features", f"""
    SELECT {i('t.rep', 'rep')}, {i('x.site', 'site')}, {d('x.date', 'date')}, {r('x.gt', 'y')},
           {r('a + b * x.b4', 'y_pred')}
    FROM fit t JOIN site_features x
    ON NOT EXISTS (SELECT 1 FROM bag WHERE bag.rep = t.rep AND bag.site = x.site)""", {
    "g": "SELECT site, count(*) AS n, md5('0|' || site) AS h FROM site_features GROUP BY ALL",
    "pos": """SELECT *, sum(n) OVER (ORDER BY h) - n AS s, sum(n) OVER () AS total,
              row_number() OVER (ORDER BY h) - 1 AS ordinal, count(*) OVER () AS m FROM g""",
    "u": """SELECT rep, (CAST('0x' || substr(md5((26 + rep) || '|' || ordinal), 1, 13) AS BIGINT)
            + 0.5) / 4503599627370496.0 * total AS u
            FROM pos, range(3) t(rep) WHERE ordinal < floor(0.8 * m)""",
    "bag": "SELECT DISTINCT rep, site FROM u JOIN pos ON u >= s AND u < s + n",
    "fit": """SELECT rep, regr_slope(gt, b4) AS b, regr_intercept(gt, b4) AS a
              FROM bag JOIN site_features USING (site) GROUP BY rep"""}))
def bootstrap_predictions(v):
    return ml.bootstrap_predictions(v.site_features, LinearRegression(), ["b4"], reps=(0, 1, 2))


@query("bootstrap_predictions_all", ORACLE["bootstrap_predictions"].replace("range(3)", "range(30)"))
def bootstrap_predictions_all(v):
    """All thirty repetitions, as the study makes them."""
    return ml.bootstrap_predictions(v.site_features, LinearRegression(), ["b4"], reps=range(30))


_GRID = """SELECT lat, lon, time, avg(l_quantity) / 7 AS x, avg(l_extendedprice) / 999.91 AS y FROM (
    SELECT round(CAST(-47.5 + 5.0 * (site % 20) AS DOUBLE), 3) AS lat,
           round(CAST(-180.0 + 7.2 * floor(site / 20.0) AS DOUBLE), 3) AS lon, date AS time,
           l_quantity, l_extendedprice FROM lines) GROUP BY ALL"""


def _grid(v):
    g = v.lines.groupBy("site", "date").agg(
        (F.avg("l_quantity") / 7).alias("x"), (F.avg("l_extendedprice") / 999.91).alias("y"))
    return v.cells(g, "x", "y").join(v.land_cover, ["lat", "lon", "time"], "left")


@query("score_grid", sql("lines land_cover", f"""
    SELECT {r('lat', 'lat')}, {r('lon', 'lon')}, {d('time', 'time')},
           {r('CASE WHEN code IS NULL OR code NOT IN (15, 16, 17) THEN a + b * x END', 'v')}
    FROM g LEFT JOIN land_cover USING (lat, lon, time),
         (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM g)""", {"g": _GRID}))
def score_grid(v):
    """Cells of excluded classes stay in the result as NULL; the model is saved and loaded first."""
    cells = pin(_grid(v), "cells")
    path = scratch_path(v.spark, "model")
    ml.save_model(ml.pipeline(LinearRegression(), ["x"]).fit(cells), path)
    return ml.score_grid(cells, ml.load_model(path), code="code")


@query("score_grid_forest")
def score_grid_forest(v):
    """A forest with one-hot classes, trained on classes and applied to codes."""
    cells = pin(_grid(v), "cells")
    names = [f"MODIS_LC_{c}" for c in SCORED_CLASS_COLUMNS]
    from panelgrid.operators.features import one_hot
    train = one_hot(cells.withColumn("MODIS_LC", recode("code", CODE_TO_CLASS)), "MODIS_LC",
                    SCORED_CLASS_COLUMNS)
    model = ml.pipeline(RandomForestRegressor(numTrees=10, maxDepth=5, seed=1),
                        ["x", *names]).fit(train)
    return ml.score_grid(cells, model, code="code", classes=SCORED_CLASS_COLUMNS)


@query("forest_search")
def forest_search(v):
    """Scores of the searched forest settings on grouped inner folds."""
    train = ml.training_table(v.site_features, TREES, "gt", None)
    _, scores = ml.search_forest(train, TREES, k=3, n_estimators=(5, 10), max_depth=(3, 5),
                                 min_samples_leaf=(2, 5), n_iter=3)
    return scores


@query("leaderboard")
def leaderboard(v):
    board, _ = ml.leaderboard(v.site_features, TREES, k=3, candidates=_small_pool())
    return board


def _small_pool():
    return {"linear_1": LinearRegression(), "boosting_1": GBTRegressor(maxIter=3, seed=1),
            "forest_1": RandomForestRegressor(numTrees=5, maxDepth=5, seed=1)}


@query("stack_importance")
def stack_importance(v):
    """Share of each candidate, with its family, in the stack."""
    pool = _small_pool()
    _, oof = ml.leaderboard(v.site_features, TREES, k=3, candidates=pool, stack=False)
    return ml.stack_importance(oof, list(pool))


_GAPS = """SELECT site, date, gt, CASE WHEN month(date) % 4 <> 1 THEN b4 END AS b4,
                  CASE WHEN site % 10 <> 3 THEN 'all' END AS label FROM site_features"""
_GAP_CV = {
    "gaps": _GAPS,
    **_fold_ctes("SELECT site AS grp, coalesce(label, '~') AS label FROM gaps", 26, 5),
    "rows": "SELECT g.*, fold FROM gaps g JOIN folds f ON g.site = f.site",
    "means": """SELECT t.fold, avg(b4) AS m FROM (SELECT DISTINCT fold FROM rows) t
                JOIN rows x ON x.fold <> t.fold GROUP BY t.fold""",
    "fit": """SELECT t.fold, any_value(m) AS m, regr_slope(gt, coalesce(b4, m)) AS b,
                     regr_intercept(gt, coalesce(b4, m)) AS a
              FROM means t JOIN rows x ON x.fold <> t.fold GROUP BY t.fold""",
}


@query("cv_predictions_gaps", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {i('x.fold', 'fold')}, {r('gt', 'y')},
           {r('a + b * coalesce(b4, m)', 'y_pred')}, 'LinearRegression' AS model
    FROM rows x JOIN fit f ON x.fold = f.fold""", _GAP_CV))
def cv_predictions_gaps(v):
    """Missing features are filled with the training mean, sites without a label get a fold."""
    gaps = v.site_features.select(
        "site", "date", "gt", F.when(F.month("date") % 4 != 1, F.col("b4")).alias("b4"),
        F.when(F.col("site") % 10 != 3, F.lit("all")).alias("label"))
    return ml.cv_predictions(gaps, LinearRegression(), ["b4"], strat="label")


@query("score_grid_gaps", sql("lines", f"""
    SELECT {r('lat', 'lat')}, {r('lon', 'lon')}, {d('time', 'time')},
           {r('a + b * coalesce(x, m)', 'v')}
    FROM gaps, (SELECT any_value(m) AS m, regr_slope(y, coalesce(x, m)) AS b,
                       regr_intercept(y, coalesce(x, m)) AS a
                FROM gaps, (SELECT avg(x) AS m FROM gaps))""", {
    "g": _GRID,
    "gaps": "SELECT lat, lon, time, y, CASE WHEN month(time) <> 6 THEN x END AS x FROM g"}))
def score_grid_gaps(v):
    """Every cell is scored, those without the feature at its training mean."""
    g = v.lines.groupBy("site", "date").agg(
        (F.avg("l_quantity") / 7).alias("x"), (F.avg("l_extendedprice") / 999.91).alias("y"))
    cells = pin(v.cells(g, "x", "y").withColumn("x", F.when(F.month("time") != 6, F.col("x"))), "cells")
    return ml.score_grid(cells, ml.pipeline(LinearRegression(), ["x"]).fit(cells))


# ---- tuning inside the training folds ----------------------------------------------------

_NAMES = ("b4", "b5", "b6", "b7")


def _one_feature():
    return {n: (LinearRegression(), [n]) for n in _NAMES}


def _tuning_ctes(k: int, inner_k: int) -> dict[str, str]:
    """Two rounds of halving over four one-feature lines, for every outer fold."""
    inner = {}
    for f in range(k):
        inner |= _fold_ctes(f"SELECT * FROM ({_ALL}) WHERE grp IN (SELECT site FROM folds WHERE fold <> {f})",
                            26, inner_k, f"inner{f}")
    values = " UNION ALL ".join(f"SELECT site, date, gt, '{n}' AS name, {n} AS x FROM site_features"
                                for n in _NAMES)
    out = {
        **_fold_ctes(_ALL, 26, k), **inner, "vals": values,
        "inner_rows": "SELECT v.*, f, i.fold AS part, draw FROM vals v JOIN ("
                      + " UNION ALL ".join(f"SELECT {f} AS f, * FROM inner{f}" for f in range(k))
                      + """) i USING (site) JOIN (SELECT DISTINCT site, (CAST('0x' || substr(md5('26|' || site),
                        1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS draw FROM site_features) USING (site)""",
        "alive1": "SELECT DISTINCT f, name FROM inner_rows"}
    for n, (share, keep) in enumerate(((0.5, 2), (1.0, 1)), 1):
        out |= {
            f"rows{n}": f"SELECT r.* FROM inner_rows r JOIN alive{n} USING (f, name) WHERE draw < {share}",
            f"fits{n}": f"""SELECT t.f, t.part, x.name, regr_slope(gt, x) AS b, regr_intercept(gt, x) AS a
                FROM (SELECT DISTINCT f, part FROM rows{n}) t JOIN rows{n} x
                ON x.f = t.f AND x.part <> t.part GROUP BY ALL""",
            f"scores{n}": f"""SELECT *, row_number() OVER (PARTITION BY f ORDER BY rmse, name) <= {keep} AS kept
                FROM (SELECT f, name, {share} AS share, sqrt(avg((gt - a - b * x) ** 2)) AS rmse
                      FROM rows{n} JOIN fits{n} USING (f, part, name) GROUP BY f, name)""",
            f"alive{n + 1}": f"SELECT f, name FROM scores{n} WHERE kept"}
    return out


@query("nested_cv", sql("site_features", f"""
    SELECT {i('v.site', 'site')}, {d('v.date', 'date')}, {i('o.fold', 'fold')}, {r('gt', 'y')},
           {r('a + b * x', 'y_pred')}, v.name AS model
    FROM vals v JOIN folds o ON v.site = o.site JOIN best w ON w.f = o.fold AND w.name = v.name""", {
    **_tuning_ctes(3, 3),
    "best": """SELECT f, v.name, regr_slope(gt, x) AS b, regr_intercept(gt, x) AS a
               FROM alive3 JOIN vals v USING (name) JOIN folds o ON v.site = o.site AND o.fold <> f
               GROUP BY f, v.name"""}))
def nested_cv(v):
    """Each outer fold is predicted by the line that won on inner folds of the other sites."""
    return ml.nested_cv(v.site_features, _one_feature(), list(_NAMES), k=3, inner_k=3)[0]


@query("nested_cv_scores", sql("site_features", f"""
    SELECT {i('f', 'fold')}, {r('share', 'share')}, name AS model, {r('rmse', 'rmse')}, {i('kept', 'kept')}
    FROM (SELECT * FROM scores1 UNION ALL SELECT * FROM scores2)""", _tuning_ctes(3, 3)))
def nested_cv_scores(v):
    """Every score of the tuning, and who went on."""
    return ml.nested_cv(v.site_features, _one_feature(), list(_NAMES), k=3, inner_k=3)[1]


@query("leaderboard_lines", sql("site_features", f"""
    SELECT name AS model, {r('1 - sum((gt - p) ** 2) / sum((gt - m) ** 2)', 'r2')},
           {r('sqrt(avg((gt - p) ** 2))', 'rmse')}
    FROM (SELECT *, avg(gt) OVER (PARTITION BY name) AS m, a + b * x AS p
          FROM rows JOIN fit USING (fold, name)) GROUP BY name""", {
    **_fold_ctes(_ALL, 26, 5),
    "rows": " UNION ALL ".join(f"SELECT fold, gt, '{n}' AS name, {n} AS x FROM site_features s "
                               "JOIN folds f ON s.site = f.site" for n in _NAMES),
    "fit": """SELECT t.fold, name, regr_slope(gt, x) AS b, regr_intercept(gt, x) AS a
              FROM (SELECT DISTINCT fold FROM rows) t JOIN rows x ON x.fold <> t.fold GROUP BY ALL"""}))
def leaderboard_lines(v):
    return ml.leaderboard(v.site_features, list(_NAMES), candidates=_one_feature(), stack=False)[0]


@query("stack_layers")
def stack_layers(v):
    """Two layers over two bags; a test compares such a stack with least squares done by hand."""
    pool = {"wide": LinearRegression(), "narrow": (LinearRegression(), ["b4"])}
    return ml.stack_layers(v.site_features, pool, list(_NAMES), layers=2, bags=2, k=2, outer_k=2)
