"""Cleaning, feature and reshaping queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelgrid.functions import columns as C
from panelgrid.functions.constants import (CODE_TO_CLASS, LAND_COVER, SITE_CODE_TO_CLASS,
                                           UNSCORED_CLASSES)
from panelgrid.operators import clean, features
from panelgrid.plans.registry import d, i, query, r
from panelgrid.plans.views import sql

CLASSES = list(dict.fromkeys(m for _, m, _ in LAND_COVER))
BANDS = ["b1", "b2", "b3", "b4", "b5", "b6", "b7"]


@query("month_end", sql("", f"""
    SELECT {i('l_orderkey', 'l_orderkey')},
           {d('last_day(make_date(year(l_shipdate), month(l_shipdate), 1))', 'date')}
    FROM lineitem"""))
def month_end(v):
    rows = v.table("lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"),
                                      F.month("l_shipdate").alias("month"))
    return clean.with_month_end(rows)


@query("recode_class", sql("quality class_map", f"""
    SELECT {i('site', 'site')}, coalesce(c.merged, q.class) AS class, {i('count(*)', 'n')}
    FROM quality q LEFT JOIN class_map c ON q.class = c.site_code GROUP BY ALL"""))
def recode_class(v):
    out = clean.recode_column(v.quality, "class", SITE_CODE_TO_CLASS, keep_unknown=True)
    return out.groupBy("site", "class").agg(F.count(F.lit(1)).alias("n"))


@query("recode_code", sql("class_map", f"""
    SELECT {i('l_partkey', 'l_partkey')}, merged AS class, {i('count(*)', 'n')}
    FROM lineitem LEFT JOIN class_map ON l_partkey % 20 = code GROUP BY ALL"""))
def recode_code(v):
    """Unknown codes (0, 18, 19) become NULL."""
    rows = v.lines.select("l_partkey", F.expr("CAST(l_partkey % 20 AS INT)").alias("class"))
    out = clean.recode_column(rows, "class", CODE_TO_CLASS, keep_unknown=False)
    return out.groupBy("l_partkey", "class").agg(F.count(F.lit(1)).alias("n"))


@query("apply_patches", sql("site_meta", f"""
    SELECT {i('site', 'site')}, CASE WHEN site = 3 THEN 'WET' WHEN site = 7 THEN 'ENF'
           ELSE class END AS class, sub, {r('elev', 'elev')} FROM site_meta"""))
def apply_patches(v):
    return clean.apply_patches(v.site_meta, "site", "class", {3: "WET", 7: "ENF"})


@query("apply_patch_table", sql("site_meta", f"""
    SELECT {i('s.site', 'site')}, coalesce(p.seg, s.class) AS class, sub, {r('elev', 'elev')}
    FROM site_meta s LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer
         WHERE c_acctbal > 5000) p ON s.site = p.k"""))
def apply_patch_table(v):
    patches = v.table("customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("class"))
    return clean.apply_patches(v.site_meta, "site", "class", patches)


@query("join_site_meta", sql("site_month site_meta", f"""
    SELECT {i('m.site', 'site')}, {d('date', 'date')}, {r('gt', 'gt')}, {r('pred', 'pred')}, class,
           {r('elev', 'elev')} FROM site_month m LEFT JOIN site_meta s ON m.site = s.site"""))
def join_site_meta(v):
    return clean.join_site_meta(v.site_month, v.site_meta, ["class", "elev"])


@query("join_site_meta_inner", sql("site_month site_meta", f"""
    SELECT s.class AS class, {i('count(*)', 'n')}, {r('avg(gt)', 'gt')}
    FROM site_month m JOIN site_meta s ON m.site = s.site GROUP BY s.class"""))
def join_site_meta_inner(v):
    j = clean.join_site_meta(v.site_month, v.site_meta, ["class"], how="inner")
    return j.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("gt").alias("gt"))


@query("sites_with_data", sql("", f"""
    SELECT {i('c_custkey', 'site')}, c_mktsegment AS class FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""))
def sites_with_data(v):
    sites = v.table("customer").select(F.col("c_custkey").alias("site"),
                                       F.col("c_mktsegment").alias("class"))
    return clean.sites_with_data(sites, v.table("orders").select(F.col("o_custkey").alias("site")))


@query("sites_without_data", sql("", f"""
    SELECT {i('p_partkey', 'site')}, p_brand AS class FROM part WHERE NOT EXISTS (
        SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)"""))
def sites_without_data(v):
    sites = v.table("part").select(F.col("p_partkey").alias("site"),
                                   F.col("p_brand").alias("class"))
    data = v.lines.where("l_quantity > 49").select(F.col("l_partkey").alias("site"))
    return clean.sites_without_data(sites, data)


@query("fill_from_panel", sql("site_features class_map site_meta", f"""
    SELECT {i('s.site', 'site')}, coalesce(CASE WHEN elev > 4000 THEN class END, l.merged) AS class
    FROM site_meta s LEFT JOIN last l ON s.site = l.site""", {
    "last": """SELECT site, arg_max_null(merged, date) AS merged FROM site_features
               LEFT JOIN class_map ON lc = code GROUP BY site"""}))
def fill_from_panel(v):
    """A third of the classes is blanked, then filled from the latest land cover."""
    sites = v.site_meta.select("site", F.when(F.col("elev") > 4000, F.col("class")).alias("class"))
    rows = clean.recode_column(v.site_features, "lc", CODE_TO_CLASS, keep_unknown=False)
    return clean.fill_from_panel(sites, rows, "class", "lc")


@query("site_overview", sql("site_month site_meta", f"""
    SELECT {i('s.site', 'site')}, class, {i('n', 'avail_months')} FROM site_meta s
    JOIN (SELECT site, count(date) AS n FROM site_month GROUP BY site) m ON s.site = m.site"""))
def site_overview(v):
    return clean.site_overview(v.site_meta.select("site", "class"), v.site_month)


@query("quality_filter", sql("quality", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('flux', 'flux')}, {r('value', 'value')},
           {r('qc', 'qc')}, class FROM quality
    WHERE flux IS NOT NULL AND value > -1 AND qc > 0.8 AND class IS DISTINCT FROM 'WAT'"""))
def quality_filter(v):
    return clean.quality_filter(v.quality, "flux", "value", "qc", "class")


@query("qa_report", sql("quality", f"""
    SELECT {i('count(*)', 'site_months')}, {i('count(DISTINCT site)', 'sites')},
           {d('min(date)', 'first_date')}, {d('max(date)', 'last_date')},
           {i('count(*) FILTER (value <= -1)', 'low_value')},
           {i('count(*) FILTER (qc <= 0.8)', 'low_qc')},
           {i("count(DISTINCT site) FILTER (class = 'WAT')", 'dropped_sites')} FROM quality"""))
def qa_report(v):
    return clean.qa_report(v.quality, "value", "qc", "class")


_UNSCORED = ", ".join(f"'{c}'" for c in UNSCORED_CLASSES)


@query("exclude_classes", sql("quality", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, class, {i('count(*)', 'n')} FROM quality
    WHERE class NOT IN ({_UNSCORED}) OR class IS NULL GROUP BY ALL"""))
def exclude_classes(v):
    kept = clean.exclude_classes(v.quality, "class", UNSCORED_CLASSES)
    return kept.groupBy("site", "date", "class").agg(F.count(F.lit(1)).alias("n"))


@query("sanitize", sql("", f"""
    SELECT {i('l_orderkey', 'l_orderkey')}, {i('l_partkey', 'l_partkey')},
           {r('CASE WHEN l_discount > 0 AND l_tax > 0 THEN l_extendedprice / 999.91 END', 'v')}
    FROM lineitem"""))
def sanitize(v):
    bad = (F.when(F.col("l_discount") == 0, F.lit(float("inf")))
           .when(F.col("l_tax") == 0, F.lit(float("nan")))
           .otherwise(F.col("l_extendedprice") / 999.91))
    return C.sanitize(v.table("lineitem").select("l_orderkey", "l_partkey", bad.alias("v")))


@query("drop_all_null", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('b1', 'b1')}, {r('b3', 'b3')}
    FROM site_features WHERE b1 IS NOT NULL OR b3 IS NOT NULL"""))
def drop_all_null(v):
    return clean.drop_all_null(v.site_features.select("site", "date", "b1", "b3"), ["b1", "b3"])


@query("drop_any_null", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('b1', 'b1')}, {r('b2', 'b2')}
    FROM site_features WHERE b1 IS NOT NULL AND b2 IS NOT NULL"""))
def drop_any_null(v):
    return clean.drop_any_null(v.site_features.select("site", "date", "b1", "b2"), ["b1", "b2"])


@query("align_outer", sql("site_month", f"""
    SELECT {i('coalesce(a.site, b.site)', 'site')}, {d('coalesce(a.date, b.date)', 'date')},
           {r('a.gt', 'gt')}, {r('b.v', 'v')}, {r('coalesce(a.gt, b.v)', 'filled')}
    FROM site_month a FULL OUTER JOIN (
        SELECT o_custkey AS site, last_day(CAST(o_orderdate AS DATE)) AS date,
               avg(o_totalprice) / 999.91 AS v FROM orders GROUP BY ALL) b
    ON a.site = b.site AND a.date = b.date"""))
def align_outer(v):
    other = v.table("orders").groupBy(
        F.col("o_custkey").alias("site"), F.last_day(F.to_date("o_orderdate")).alias("date")).agg(
        (F.avg("o_totalprice") / 999.91).alias("v"))
    j = clean.align_outer(v.site_month.select("site", "date", "gt"), other, ["site", "date"])
    return j.withColumn("filled", F.coalesce("gt", "v"))


@query("reindex_to", sql("site_features", f"""
    SELECT {i('a.site', 'site')}, {d('a.date', 'date')}, {r('b.b2', 'b2')}
    FROM site_features a LEFT JOIN (SELECT * FROM site_features WHERE b2 IS NOT NULL AND b1 > 3.5) b
    ON a.site = b.site AND a.date = b.date"""))
def reindex_to(v):
    kept = v.site_features.where("b2 IS NOT NULL AND b1 > 3.5").select("site", "date", "b2")
    return clean.reindex_to(kept, v.site_features, ["site", "date"])


@query("union_reps", sql("lines", f"""
    SELECT {i('site', 'site')}, {r('l_quantity', 'q')}, 'first' AS rep FROM lines
    WHERE l_returnflag = 'R'
    UNION ALL SELECT {i('site', 'site')}, {r('l_quantity', 'q')}, 'second' FROM lines
    WHERE l_returnflag = 'A'
    UNION ALL SELECT {i('site', 'site')}, {r('l_quantity', 'q')}, 'third' FROM lines
    WHERE l_returnflag = 'N'"""))
def union_reps(v):
    q = v.lines.select("site", F.col("l_quantity").alias("q"), "l_returnflag")
    names = {"first": "R", "second": "A", "third": "N"}
    return clean.union_tagged({n: q.where(F.col("l_returnflag") == f).drop("l_returnflag")
                               for n, f in names.items()})


@query("zscore", sql("bench", f"""
    SELECT {d('block', 'block')}, treatment, {r('metric', 'metric')},
           {r('''(metric - avg(metric) OVER (PARTITION BY treatment))
               / stddev_samp(metric) OVER (PARTITION BY treatment)''', 'z')} FROM bench"""))
def zscore(v):
    return clean.zscore(v.bench, "metric", ["treatment"])


@query("feature_set", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {', '.join(r(b, b) for b in BANDS)},
           {r('"BESS-PAR"', '"BESS-PAR"')}, {i('year(date)', 'year')}, {r('gt', 'gt')}
    FROM site_features"""))
def feature_set(v):
    return features.feature_set(v.site_features, "rs_min_yr", target=["gt"])


@query("feature_set_encoded", sql("site_features class_map", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('b1', 'b1')}, {r('gt', 'gt')},
           {', '.join(r(f"CASE WHEN merged = '{c}' THEN 1 ELSE 0 END", f"MODIS_LC_{c}")
                      for c in CLASSES)}
    FROM site_features LEFT JOIN class_map ON lc = code"""))
def feature_set_encoded(v):
    rows = v.site_features.withColumn("MODIS_LC", C.recode("lc", CODE_TO_CLASS))
    return features.feature_set(rows, ["b1", "MODIS_LC"], target=["gt"], encode=["MODIS_LC"])


@query("one_hot", sql("site_meta", f"""
    SELECT {i('site', 'site')}, {', '.join(r(f"CASE WHEN class = '{c}' THEN 1 ELSE 0 END",
                                             f'"class_{c}"')
           for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))} FROM site_meta"""))
def one_hot(v):
    return features.one_hot(v.site_meta.select("site", "class"), "class")


_STORED = ["BSV", "CRO", "ENF", "SH", "XXX"]


@query("one_hot_aligned", sql("quality", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('sum(value)', 'value')},
           {', '.join(r(f"sum(CASE WHEN class = '{c}' THEN 1 ELSE 0 END)", f"class_{c}")
                      for c in _STORED)} FROM quality GROUP BY site, date"""))
def one_hot_aligned(v):
    """Columns of a stored list: an unknown one is 0, classes outside the list are dropped."""
    flat = features.one_hot(v.quality.select("site", "date", "value", "class"), "class", _STORED)
    return flat.groupBy("site", "date").agg(
        F.sum("value").alias("value"), *[F.sum(f"class_{c}").alias(f"class_{c}") for c in _STORED])


@query("reverse_one_hot", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, CASE
        WHEN b4 IS NULL AND b5 IS NULL AND b1 IS NULL THEN NULL
        WHEN coalesce(b1, -1) >= greatest(b1, b4, b5) THEN 'b1'
        WHEN coalesce(b4, -1) >= greatest(b1, b4, b5) THEN 'b4' ELSE 'b5' END AS top
    FROM site_features"""))
def reverse_one_hot(v):
    out = features.reverse_one_hot(v.site_features, ["b1", "b4", "b5"], "top")
    return out.select("site", "date", "top")


@query("row_mean", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')},
           {r('list_avg(list_filter([b1, b2, b3], lambda x: x IS NOT NULL))', 'mean')}
    FROM site_features"""))
def row_mean(v):
    return v.site_features.select("site", "date", features.row_mean(["b1", "b2", "b3"])
                                  .alias("mean"))


@query("row_shares", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')},
           {', '.join(r(f'{c} / nullif(coalesce(b1, 0) + coalesce(b2, 0) + coalesce(b3, 0), 0)', c)
                      for c in ('b1', 'b2', 'b3'))} FROM site_features"""))
def row_shares(v):
    return features.row_shares(v.site_features.select("site", "date", "b1", "b2", "b3"),
                               ["b1", "b2", "b3"])


@query("columns_with_prefix", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {', '.join(r(b, b) for b in BANDS)}
    FROM site_features"""))
def columns_with_prefix(v):
    f = v.site_features
    return f.select("site", "date", *features.columns_with_prefix(f, "b"))


@query("ensemble_mean", sql("site_month_rep", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('any_value(gt)', 'gt')},
           {r('avg(pred)', 'pred')} FROM site_month_rep GROUP BY site, date"""))
def ensemble_mean(v):
    return features.ensemble_mean(v.site_month_rep, carry=["gt"])


@query("scale_units", sql("site_month", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('gt * day(date) * 12', 'yearly')}
    FROM site_month"""))
def scale_units(v):
    return v.site_month.select("site", "date", (F.col("gt") * C.days_in_month("date") * 12)
                               .alias("yearly"))


@query("drop_outlier", sql("bench", f"""
    SELECT {d('block', 'block')}, treatment, {r('metric', 'metric')} FROM bench
    WHERE treatment IN ('1-URGENT', '2-HIGH', '5-LOW') AND block <> DATE '1996-05-31'"""))
def drop_outlier(v):
    kept = clean.keep_labels(v.bench, "treatment", ["1-URGENT", "2-HIGH", "5-LOW"])
    return clean.drop_ids(kept, "block", [dt.date(1996, 5, 31)])
