"""Questions a study asks of saved scores and predictions: chains of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import clean, features, panel, scores, split, summarize
from panelgrid.plans.panel_queries import X
from panelgrid.plans.registry import ORACLE, d, i, query, r
from panelgrid.plans.summary_queries import _ROWS, _fold_ctes, _labelled
from panelgrid.plans.views import sql

PARTS = ["r2_overall", "r2_msc"]

# R2 in total and on the season, per repetition and site
_SCORED = {
    "o": """SELECT rep, site, 1 - sum((gt - pred) ** 2) / nullif(sum((gt - g0) ** 2), 0) AS r2_overall
            FROM (SELECT *, avg(gt) OVER (PARTITION BY rep, site) AS g0 FROM site_month_rep)
            GROUP BY rep, site HAVING count(gt) >= 24""",
    "m": """SELECT rep, site, 1 - sum((mg - mp) ** 2) / nullif(sum((mg - mg0) ** 2), 0) AS r2_msc
            FROM (SELECT *, avg(mg) OVER (PARTITION BY rep, site) AS mg0 FROM (
                  SELECT rep, site, month(date) AS mo, avg(gt) AS mg, avg(pred) AS mp
                  FROM site_month_rep GROUP BY ALL)) GROUP BY rep, site""",
    "s": """SELECT rep, site, class, r2_overall, r2_msc
            FROM o JOIN m USING (rep, site) JOIN site_meta USING (site)""",
    "long": """SELECT rep, site, class, 'r2_overall' AS metric, r2_overall AS value FROM s
               UNION ALL SELECT rep, site, class, 'r2_msc', r2_msc FROM s""",
}


def _by_class(v):
    return scores.eval_by_class(v.site_month_rep, v.site_meta, min_months=24)


@query("class_summary", sql("site_month_rep site_meta", f"""
    SELECT class, metric, {i('count(value)', 'n')}, {r('avg(value)', 'mean')},
           {r('stddev_samp(value) / sqrt(count(value))', 'sem')},
           {r('quantile_cont(value, 0.5)', 'median')}
    FROM long GROUP BY class, metric""", _SCORED))
def class_summary(v):
    """Mean, median and standard error of the site scores per class."""
    return scores.metric_summary(_by_class(v), ["class"], PARTS)


@query("class_box", sql("site_month_rep site_meta", f"""
    SELECT class, metric, {i('count(*)', 'n')}, {r('any_value(q1)', 'q1')},
           {r('any_value(q2)', 'median')}, {r('any_value(q3)', 'q3')},
           {r('least(min(x) FILTER (x >= lo AND x <= hi), any_value(q1))', 'whisker_low')},
           {r('greatest(max(x) FILTER (x >= lo AND x <= hi), any_value(q3))', 'whisker_high')},
           {i('count(*) FILTER (x < lo OR x > hi)', 'outliers')}
    FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
          FROM a JOIN q USING (class, metric)) GROUP BY class, metric""", {
    **_SCORED,
    "a": """SELECT site, class, metric, avg(value) AS x FROM long GROUP BY ALL""",
    "q": """SELECT class, metric, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
            quantile_cont(x, 0.75) AS q3 FROM a GROUP BY ALL"""}))
def class_box(v):
    """Box statistics over sites of the scores averaged over repetitions."""
    long = summarize.melt(_by_class(v), ["site", "class"], PARTS, "metric", "x")
    mean = long.groupBy("site", "class", "metric").agg(F.avg("x").alias("x"))
    return summarize.box_stats(mean, "x", ["class", "metric"])


# Two resolutions: the full prediction, and the mean of three repetitions, missing in some months.
_TWO = {
    "fine": """SELECT site, date, avg(CASE WHEN rep <= 3 THEN pred END) AS fine
               FROM site_month_rep GROUP BY ALL""",
    "y": "SELECT site, date, gt, pred AS coarse, fine FROM site_month LEFT JOIN fine USING (site, date)",
}


def _two(v, every=False):
    reps = v.site_month_rep
    if not every:
        reps = reps.withColumn("pred", F.when(F.col("rep") <= 3, F.col("pred")))
    fine = features.ensemble_mean(reps).withColumnRenamed("pred", "fine")
    return clean.align_outer(v.site_month.withColumnRenamed("pred", "coarse"), fine,
                             ["site", "date"])


@query("resolution_total", sql("site_month_rep", f"""
    SELECT {r('gt', 'gt')}, resolution, {r('value', 'value')} FROM (
        SELECT gt, 'coarse' AS resolution, coarse AS value FROM y
        UNION ALL SELECT gt, 'fine', fine FROM y)""", _TWO))
def resolution_total(v, every=False):
    return summarize.melt(_two(v, every).select("gt", "coarse", "fine"), ["gt"], ["coarse", "fine"],
                          "resolution")


@query("resolution_msc", sql("site_month_rep", f"""
    SELECT {i('site', 'site')}, {i('month', 'month')}, {r('gt', 'gt')}, resolution,
           {r('value', 'value')} FROM (
        SELECT site, month, gt, 'coarse' AS resolution, coarse AS value FROM m
        UNION ALL SELECT site, month, gt, 'fine', fine FROM m)""", {
    **_TWO, "m": """SELECT site, month(date) AS month, avg(gt) AS gt, avg(coarse) AS coarse,
                    avg(fine) AS fine FROM y GROUP BY ALL"""}))
def resolution_msc(v, every=False):
    m = _two(v, every).groupBy("site", F.month("date").alias("month")).agg(
        *[F.avg(c).alias(c) for c in ("gt", "coarse", "fine")])
    return summarize.melt(m, ["site", "month", "gt"], ["coarse", "fine"], "resolution")


@query("resolution_trend", sql("site_month_rep", f"""
    SELECT {i('site', 'site')}, {r('gt', 'gt')}, resolution, {r('value', 'value')} FROM (
        SELECT site, gt, 'coarse' AS resolution, coarse AS value FROM t
        UNION ALL SELECT site, gt, 'fine', fine FROM t)""", {
    **_TWO, "t": f"""SELECT site, regr_slope(gt, {X}) AS gt, regr_slope(coarse, {X}) AS coarse,
                     regr_slope(fine, {X}) AS fine FROM y WHERE fine IS NOT NULL GROUP BY site
                     HAVING count(gt) >= 24"""}))
def resolution_trend(v, every=False):
    """Site slopes over complete rows of sites with two years of data."""
    complete = clean.drop_any_null(_two(v, every), ["gt", "coarse", "fine"])
    t = panel.across_site_trend(panel.min_months(complete, "gt", 24), ["gt", "coarse", "fine"])
    return summarize.melt(t, ["site", "gt"], ["coarse", "fine"], "resolution")


@query("resolution_anomalies", sql("site_month_rep", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {', '.join(r(
        f'd{c} - (regr_intercept(d{c}, x) OVER w + x * regr_slope(d{c}, x) OVER w)', c)
        for c in ('gt', 'coarse', 'fine'))}
    FROM dev WINDOW w AS (PARTITION BY site)""", {
    **_TWO, "dev": f"SELECT site, date, {X} AS x, " + ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY site, month(date)) AS d{c}"
        for c in ("gt", "coarse", "fine")) + " FROM y"}))
def resolution_anomalies(v, every=False):
    y = _two(v, every)
    for c in ("gt", "coarse", "fine"):
        y = panel.iav(y, c, detrend=True, out=f"_{c}")
    return y.select("site", "date", *[F.col(f"_{c}").alias(c) for c in ("gt", "coarse", "fine")])


def _of_every_repetition(name, fn):
    """The query and its SQL twin once more, with the mean of all repetitions, as the study takes it."""
    three = "CASE WHEN rep <= 3 THEN pred END"
    query(f"{name}_all", ORACLE[name].replace(three, "pred"))(lambda v: fn(v, every=True))


for _name, _fn in (("resolution_total", resolution_total), ("resolution_msc", resolution_msc),
                   ("resolution_trend", resolution_trend),
                   ("resolution_anomalies", resolution_anomalies)):
    _of_every_repetition(_name, _fn)


@query("fold_class_counts", sql("site_meta", f"""
    SELECT class, {', '.join(i(f'count(*) FILTER (fold = {k})', f'"{k}"') for k in range(5))}
    FROM folds JOIN site_meta USING (site) GROUP BY class""", _fold_ctes(_ROWS, 26, 5)))
def fold_class_counts(v):
    """How the classes of sites spread over the test folds."""
    folds = split.group_kfold(_labelled(v), "site", "label", k=5, seed=26)
    tagged = split.fold_membership(v.site_meta, folds)
    return summarize.pivot_counts(tagged, ["class"], "test_fold", list(range(5)))


@query("fold_lengths", sql("site_month", f"""
    SELECT {i('test_fold', 'test_fold')}, {i('count(*)', 'n')},
           {r('quantile_cont(len, 0.25)', 'q0')}, {r('quantile_cont(len, 0.5)', 'q1')},
           {r('quantile_cont(len, 0.75)', 'q2')}
    FROM (SELECT fold AS test_fold, site, count(date) AS len FROM site_month JOIN folds USING (site)
          GROUP BY ALL) GROUP BY test_fold""", _fold_ctes(_ROWS, 26, 5)))
def fold_lengths(v):
    """Quartiles of the record length of the sites in each test fold."""
    folds = split.group_kfold(_labelled(v), "site", "label", k=5, seed=26)
    length = panel.available_months(v.site_month).withColumn(
        "len", F.col("avail_months").cast("double"))
    return summarize.quantiles(split.fold_membership(length, folds), "len", [.25, .5, .75],
                               ["test_fold"])


@query("fold_r2", sql("site_month", f"""
    SELECT {i('fold', 'test_fold')}, {r('1 - sum((gt - pred) ** 2) / sum((gt - m) ** 2)', 'r2')}
    FROM (SELECT *, avg(gt) OVER (PARTITION BY fold) AS m FROM site_month JOIN folds USING (site))
    GROUP BY fold""", _fold_ctes(_ROWS, 26, 5)))
def fold_r2(v):
    """R2 of each test fold, to find the one behind an outlier."""
    folds = split.group_kfold(_labelled(v), "site", "label", k=5, seed=26)
    return scores.r2(split.fold_membership(v.site_month, folds), by=["test_fold"])
