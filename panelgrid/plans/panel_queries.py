"""Panel and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import panel, scores
from panelgrid.plans.registry import d, i, query, r
from panelgrid.plans.views import sql

X = "((year(date) - 1970) * 12 + month(date) - 1)"

_R2 = "CASE WHEN count(*) < 2 THEN NULL ELSE 1 - {res} / nullif({tot}, 0) END"


def _decomposed(table: str, keys: str) -> dict[str, str]:
    """Textbook window form of season, line and anomaly for truth and prediction."""
    k = keys
    return {
        "dev": f"""SELECT *, {X} AS x,
            gt - avg(gt) OVER (PARTITION BY {k}, month(date)) AS dg,
            pred - avg(pred) OVER (PARTITION BY {k}, month(date)) AS dp FROM {table}""",
        "fit": f"""SELECT *, coalesce(regr_slope(dg, x) OVER (PARTITION BY {k}), 0) AS bg,
            avg(x) OVER (PARTITION BY {k}) AS xm,
            coalesce(regr_slope(dp, x) OVER (PARTITION BY {k}), 0) AS bp FROM dev""",
        "anom": "SELECT *, dg - bg * (x - xm) AS ag, dp - bp * (x - xm) AS ap FROM fit",
    }


EVAL_SQL = sql("site_month_rep", f"""
    SELECT {i('o.rep', 'rep')}, {r('r2_overall', 'r2_overall')}, {r('r2_trend', 'r2_trend')},
           {r('r2_anomalies', 'r2_anomalies')}, {r('r2_sites', 'r2_sites')},
           {r('r2_msc', 'r2_msc')}, {r('rmse_overall', 'rmse_overall')},
           {r('rmse_trend', 'rmse_trend')}, {r('rmse_anomalies', 'rmse_anomalies')},
           {r('rmse_sites', 'rmse_sites')}, {r('rmse_msc', 'rmse_msc')}
    FROM o JOIN a ON o.rep = a.rep JOIN t ON o.rep = t.rep JOIN m ON o.rep = m.rep""", {
    "kept": """SELECT * FROM (SELECT *, count(gt) OVER (PARTITION BY rep, site) AS len
                             FROM site_month_rep) WHERE len >= 24""",
    **_decomposed("kept", "rep, site"),
    "o0": "SELECT *, avg(gt) OVER (PARTITION BY rep) AS g0 FROM kept",
    "o": """SELECT rep, 1 - sum((gt - pred) ** 2) / sum((gt - g0) ** 2) AS r2_overall,
            sqrt(avg((gt - pred) ** 2)) AS rmse_overall FROM o0 GROUP BY rep""",
    "a0": "SELECT *, avg(ag) OVER (PARTITION BY rep) AS a0 FROM anom",
    "a": """SELECT rep, 1 - sum((ag - ap) ** 2) / sum((ag - a0) ** 2) AS r2_anomalies,
            sqrt(avg((ag - dp) ** 2)) AS rmse_anomalies FROM a0 GROUP BY rep""",
    "site0": f"""SELECT rep, site, avg(gt) AS mg, avg(pred) AS mp,
            coalesce(regr_slope(gt, {X}), 0) AS bg, coalesce(regr_slope(pred, {X}), 0) AS bp
            FROM kept GROUP BY rep, site""",
    "site1": """SELECT *, avg(mg) OVER (PARTITION BY rep) AS mg0,
            avg(bg) OVER (PARTITION BY rep) AS bg0 FROM site0""",
    "t": """SELECT rep, 1 - sum((mg - mp) ** 2) / sum((mg - mg0) ** 2) AS r2_sites,
            sqrt(avg((mg - mp) ** 2)) AS rmse_sites,
            1 - sum((bg - bp) ** 2) / sum((bg - bg0) ** 2) AS r2_trend,
            sqrt(avg((bg - bp) ** 2)) AS rmse_trend FROM site1 GROUP BY rep""",
    "m0": """SELECT rep, site, month(date) AS mo, avg(gt) AS mg, avg(pred) AS mp
            FROM kept GROUP BY ALL""",
    "m1": "SELECT *, avg(mg) OVER (PARTITION BY rep) AS mg0 FROM m0",
    "m": """SELECT rep, 1 - sum((mg - mp) ** 2) / sum((mg - mg0) ** 2) AS r2_msc,
            sqrt(avg((mg - mp) ** 2)) AS rmse_msc FROM m1 GROUP BY rep""",
})


@query("eval_metrics", EVAL_SQL)
def eval_metrics(v):
    return scores.eval_metrics(v.site_month_rep, min_months=24)


@query("eval_metrics_symmetric", EVAL_SQL.replace("(ag - dp) ** 2", "(ag - ap) ** 2"))
def eval_metrics_symmetric(v):
    return scores.eval_metrics(v.site_month_rep, min_months=24, symmetric=True)


@query("eval_by_class", sql("site_month_rep site_meta", f"""
    SELECT {i('o.rep', 'rep')}, {i('o.site', 'site')}, s.class AS class,
           {r('r2_overall', 'r2_overall')}, {r('r2_msc', 'r2_msc')},
           {r('r2_anomalies', 'r2_anomalies')}
    FROM o JOIN m ON o.rep = m.rep AND o.site = m.site JOIN site_meta s ON o.site = s.site""", {
    "kept": """SELECT * FROM (SELECT *, count(gt) OVER (PARTITION BY rep, site) AS len
                             FROM site_month_rep) WHERE len >= 24""",
    **_decomposed("kept", "rep, site"),
    "o0": """SELECT *, avg(gt) OVER (PARTITION BY rep, site) AS g0,
             avg(ag) OVER (PARTITION BY rep, site) AS a0 FROM anom""",
    "o": """SELECT rep, site, 1 - sum((gt - pred) ** 2) / sum((gt - g0) ** 2) AS r2_overall,
            1 - sum((ag - ap) ** 2) / sum((ag - a0) ** 2) AS r2_anomalies
            FROM o0 GROUP BY rep, site""",
    "m0": """SELECT rep, site, month(date) AS mo, avg(gt) AS mg, avg(pred) AS mp
            FROM kept GROUP BY ALL""",
    "m1": "SELECT *, avg(mg) OVER (PARTITION BY rep, site) AS mg0 FROM m0",
    "m": """SELECT rep, site, 1 - sum((mg - mp) ** 2) / sum((mg - mg0) ** 2) AS r2_msc
            FROM m1 GROUP BY rep, site"""}))
def eval_by_class(v):
    return scores.eval_by_class(v.site_month_rep, v.site_meta, min_months=24)


@query("r2", sql("site_month_rep", f"""
    SELECT {i('rep', 'rep')}, {r('1 - sum((gt - pred) ** 2) / sum((gt - g0) ** 2)', 'r2')}
    FROM (SELECT *, avg(gt) OVER (PARTITION BY rep) AS g0 FROM site_month_rep) GROUP BY rep"""))
def r2(v):
    return scores.r2(v.site_month_rep, by=["rep"])


@query("rmse", sql("site_month_rep", f"""
    SELECT {i('rep', 'rep')}, {r('sqrt(avg((gt - pred) ** 2))', 'rmse')}
    FROM site_month_rep GROUP BY rep"""))
def rmse(v):
    return scores.rmse(v.site_month_rep, by=["rep"])


@query("across_site_variability", sql("site_month", f"""
    SELECT {i('site', 'site')}, {r('avg(gt)', 'gt')}, {r('avg(pred)', 'pred')}
    FROM site_month GROUP BY site"""))
def across_site_variability(v):
    return panel.across_site_variability(v.site_month, ["gt", "pred"])


@query("across_site_trend", sql("site_month", f"""
    SELECT {i('site', 'site')}, {r(f'coalesce(regr_slope(gt, {X}), 0)', 'gt')},
           {r(f'coalesce(regr_slope(pred, {X}), 0)', 'pred')} FROM site_month GROUP BY site"""))
def across_site_trend(v):
    return panel.across_site_trend(v.site_month, ["gt", "pred"])


@query("annual_mean", sql("site_month", f"""
    SELECT {i('site', 'site')}, {i('year(date)', 'year')}, {r('avg(gt)', 'annual_mean')}
    FROM site_month GROUP BY site, year(date)"""))
def annual_mean(v):
    return panel.annual_mean(v.site_month, "gt")


@query("annual_mean_transform", sql("site_month", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')},
           {r('avg(gt) OVER (PARTITION BY site, year(date))', 'annual_mean')} FROM site_month"""))
def annual_mean_transform(v):
    return panel.annual_mean(v.site_month, "gt", transform=True)


@query("msc", sql("site_month", f"""
    SELECT {i('site', 'site')}, {i('month(date)', 'month')}, {r('avg(gt)', 'msc')}
    FROM site_month GROUP BY site, month(date)"""))
def msc(v):
    return panel.msc(v.site_month, "gt")


@query("msc_no_mean", sql("site_month", f"""
    SELECT {i('site', 'site')}, {i('month(date)', 'month')}, {r('avg(g)', 'msc')}
    FROM (SELECT *, gt - avg(gt) OVER (PARTITION BY site) AS g FROM site_month)
    GROUP BY site, month(date)"""))
def msc_no_mean(v):
    return panel.msc(v.site_month, "gt", no_mean=True)


@query("msc_transform", sql("site_month", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')},
           {r('avg(gt) OVER (PARTITION BY site, month(date))', 'msc')} FROM site_month"""))
def msc_transform(v):
    return panel.msc(v.site_month, "gt", transform=True)


@query("iav", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')},
           {r('gt - avg(gt) OVER (PARTITION BY site, month(date))', 'iav')}
    FROM site_month_gaps"""))
def iav(v):
    return panel.iav(v.site_month_gaps, "gt")


@query("iav_detrended", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')},
           {r('dg - (regr_intercept(dg, x) OVER w + x * regr_slope(dg, x) OVER w)', 'iav')}
    FROM dev WINDOW w AS (PARTITION BY site)""", {
    "dev": f"""SELECT *, {X} AS x, gt - avg(gt) OVER (PARTITION BY site, month(date)) AS dg
               FROM site_month_gaps"""}))
def iav_detrended(v):
    return panel.iav(v.site_month_gaps, "gt", detrend=True)


@query("trend", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')},
           {r(f'''CASE WHEN gt IS NOT NULL THEN regr_intercept(gt, {X}) OVER w
                  + {X} * regr_slope(gt, {X}) OVER w END''', 'trend')}
    FROM site_month_gaps WINDOW w AS (PARTITION BY site)"""))
def trend(v):
    return panel.trend(v.site_month_gaps, "gt")


@query("gap_fill", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')},
           {r('''coalesce(gt, (last_value(gt IGNORE NULLS) OVER (PARTITION BY site ORDER BY date
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 + first_value(gt IGNORE NULLS) OVER (PARTITION BY site ORDER BY date
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 2)''', 'gt')},
           {r('pred', 'pred')} FROM site_month_gaps"""))
def gap_fill(v):
    return panel.gap_fill(v.site_month_gaps, ["gt"])


@query("series_length", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')},
           {i('count(gt) OVER (PARTITION BY site)', 'series_length')} FROM site_month_gaps"""))
def series_length(v):
    return panel.series_length(v.site_month_gaps, "gt")


@query("min_months", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')}
    FROM (SELECT *, count(gt) OVER (PARTITION BY site) AS n FROM site_month_gaps) WHERE n >= 61"""))
def min_months(v):
    return panel.min_months(v.site_month_gaps, "gt", 61)


@query("drop_empty_dates", sql("site_month_gaps", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')}
    FROM (SELECT *, count(gt) OVER (PARTITION BY date) AS n FROM site_month_gaps) WHERE n > 0"""))
def drop_empty_dates(v):
    return panel.drop_empty_dates(v.site_month_gaps, "gt")


@query("class_changed", sql("", f"""
    SELECT {i('l_suppkey', 'site')} FROM lineitem
    GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1"""))
def class_changed(v):
    return panel.class_changed(v.lines, "l_returnflag")


@query("last_per_site", sql("site_features", f"""
    SELECT {i('site', 'site')}, {r('arg_max_null(lc, date)', 'lc')},
           {r('arg_max_null(b2, date)', 'b2')} FROM site_features GROUP BY site"""))
def last_per_site(v):
    return panel.last_per_site(v.site_features, ["lc", "b2"]).withColumn(
        "lc", F.col("lc").cast("double"))


@query("first_known", sql("site_features", f"""
    SELECT {i('site', 'site')}, {r('arg_min(b2, date)', 'b2')}, {r('arg_min(b3, date)', 'b3')}
    FROM site_features GROUP BY site"""))
def first_known(v):
    return panel.first_known(v.site_features, ["b2", "b3"])


@query("metric_summary", sql("site_month_rep", f"""
    SELECT {i('rep', 'rep')}, metric, {i('count(value)', 'n')}, {r('avg(value)', 'mean')},
           {r('stddev_samp(value) / sqrt(count(value))', 'sem')},
           {r('quantile_cont(value, 0.5)', 'median')}
    FROM long GROUP BY rep, metric""", {
    "long": """SELECT rep, 'gt' AS metric, gt AS value FROM site_month_rep
               UNION ALL SELECT rep, 'pred', pred FROM site_month_rep"""}))
def metric_summary(v):
    return scores.metric_summary(v.site_month_rep, ["rep"], ["gt", "pred"])


@query("bias_by_quartile", sql("site_month", f"""
    SELECT {i('bin', 'bin')}, {r('lo', 'lo')}, {r('hi', 'hi')}, {i('count(gt)', 'n')},
           {r('quantile_cont(pred - gt, 0.5)', 'median_bias')}
    FROM bins JOIN site_month ON gt BETWEEN lo AND hi GROUP BY bin, lo, hi""", {
    "q": "SELECT quantile_cont(gt, [0, 0.25, 0.5, 0.75, 1]) AS e FROM site_month",
    "bins": """SELECT b AS bin, e[b] AS lo, e[b + 1] AS hi
               FROM q, (SELECT unnest([1, 2, 3, 4]) AS b)"""}))
def bias_by_quartile(v):
    return scores.bias_by_quantile(v.site_month, "gt", "pred")


@query("share_above", sql("site_month_rep", f"""
    SELECT 'gt' AS name, {r('avg(CASE WHEN gt > 40 THEN 1.0 ELSE 0.0 END)', 'share')},
           {r('sum(CASE WHEN gt > 40 THEN gt ELSE 0 END) / count(*)', 'sum_over_rows')}
    FROM site_month_rep
    UNION ALL
    SELECT 'pred', {r('avg(CASE WHEN pred > 40 THEN 1.0 ELSE 0.0 END)', 'share')},
           {r('sum(CASE WHEN pred > 40 THEN pred ELSE 0 END) / count(*)', 'sum_over_rows')}
    FROM site_month_rep"""))
def share_above(v):
    return scores.share_above(v.site_month_rep, ["gt", "pred"], 40.0)
