"""Grid, map, sample and product-comparison queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelgrid.functions.cdf import student_critical
from panelgrid.functions.columns import round_coord, wrap_lon
from panelgrid.functions.constants import REPORTED_CLASSES
from panelgrid.operators import features, grid, maps, sample, scores, stats
from panelgrid.plans.registry import d, i, query, r
from panelgrid.plans.views import sql

CELL = f"{r('lat', 'lat')}, {r('lon', 'lon')}"
WRAPPED = "round(CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END, 9)"


@query("round_coords", sql("", f"""
    SELECT {i('c_custkey', 'c_custkey')}, {r('round_even(CAST(c_acctbal AS DOUBLE) / 7 * 1000, 0) / 1000', 'x')} FROM customer"""))
def round_coords(v):
    return v.table("customer").select("c_custkey", round_coord(F.col("c_acctbal") / 7).alias("x"))


@query("wrap_lon", sql("", f"""
    SELECT {i('c_custkey', 'c_custkey')},
           {r('(c_acctbal + 180) - 360 * floor((c_acctbal + 180) / 360) - 180', 'lon')}
    FROM customer"""))
def wrap(v):
    """Account balances as longitudes far outside -180..180."""
    return v.table("customer").select("c_custkey", wrap_lon("c_acctbal").alias("lon"))


@query("grid_stride", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {i('rep', 'rep')}, {r('v', 'v')} FROM ens
    WHERE lat IN (SELECT lat FROM a WHERE k % 5 = 0) AND lon IN (SELECT lon FROM o WHERE k % 5 = 0)
    """, {"a": "SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS k FROM (SELECT DISTINCT lat FROM ens)",
          "o": "SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS k FROM (SELECT DISTINCT lon FROM ens)"}))
def grid_stride(v):
    return grid.grid_stride(v.ens, 5)


@query("time_slice", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {i('rep', 'rep')}, {r('v', 'v')} FROM ens
    WHERE time BETWEEN DATE '1996-01-31' AND DATE '1997-12-31'"""))
def time_slice(v):
    return grid.time_slice(v.ens, dt.date(1996, 1, 31), dt.date(1997, 12, 31))


@query("month_select", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {i('rep', 'rep')}, {r('v', 'v')} FROM ens
    WHERE month(time) = 7"""))
def month_select(v):
    return grid.month_of_year(v.ens, 7)


@query("resample_monthly", sql("daily", f"""
    SELECT {i('site', 'site')}, {d('last_day(date)', 'date')}, {r('avg(v)', 'v')}
    FROM daily GROUP BY site, last_day(date)"""))
def resample_monthly(v):
    return grid.resample_monthly(v.daily, ["site"], ["v"], "date")


@query("resample_monthly_filled", sql("", f"""
    SELECT {i('c.k', 'k')}, {d('m.date', 'date')}, {r('a.v', 'v')}
    FROM (SELECT DISTINCT k FROM o) c CROSS JOIN
         (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(date)),
                 date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE)) AS date FROM o) m
    LEFT JOIN (SELECT k, last_day(date) AS date, avg(v) AS v FROM o GROUP BY ALL) a
    ON a.k = c.k AND a.date = m.date""", {
    "o": """SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date, o_totalprice / 999.91 AS v
            FROM orders"""}))
def resample_monthly_filled(v):
    o = v.table("orders").select(F.col("o_custkey").alias("k"),
                                 F.to_date("o_orderdate").alias("date"),
                                 (F.col("o_totalprice") / 999.91).alias("v"))
    return grid.resample_monthly(o, ["k"], ["v"], "date", fill_gaps=True)


@query("resample_yearly", sql("daily", f"""
    SELECT {i('site', 'site')}, {d('make_date(year(date), 12, 31)', 'date')}, {r('avg(v)', 'v')}
    FROM daily GROUP BY site, year(date)"""))
def resample_yearly(v):
    return grid.resample_yearly(v.daily, ["site"], ["v"], "date")


_NEAR = {ax: f"""SELECT t.{ax}, first(s.{ax} ORDER BY abs(s.{ax} - t.{ax}), s.{ax} DESC) AS s{ax}
    FROM (SELECT DISTINCT {ax} FROM ens) t, (SELECT DISTINCT {ax} FROM {{src}}) s
    GROUP BY t.{ax}""" for ax in ("lat", "lon")}


@query("nearest_snap", sql("ens prod_b", f"""
    SELECT {r('e.lat', 'lat')}, {r('e.lon', 'lon')}, {d('e.time', 'time')}, {r('e.v', 'v')},
           {r('p.v', 'other')}
    FROM (SELECT lat, lon, time, avg(v) AS v FROM ens GROUP BY ALL) e
    JOIN a ON e.lat = a.lat JOIN o ON e.lon = o.lon
    LEFT JOIN prod_b p ON p.lat = a.slat AND p.lon = o.slon AND p.time = e.time""",
    {"a": _NEAR["lat"].format(src="prod_b"), "o": _NEAR["lon"].format(src="prod_b")}))
def nearest_snap(v):
    other = v.prod_b.withColumnRenamed("v", "other")
    return grid.nearest_snap(maps.rep_mean(v.ens), other, ["other"], on=["time"])


@query("nearest_snap_inside", sql("ens prod_b", f"""
    SELECT {r('e.lat', 'lat')}, {r('e.lon', 'lon')}, {r('p.v', 'other')}
    FROM (SELECT DISTINCT lat, lon FROM ens) e JOIN a ON e.lat = a.lat JOIN o ON e.lon = o.lon
    LEFT JOIN b p ON e.lat >= (SELECT min(lat) FROM b) AND e.lat <= (SELECT max(lat) FROM b)
         AND e.lon >= (SELECT min(lon) FROM b) AND e.lon <= (SELECT max(lon) FROM b)
         AND p.lat = a.slat AND p.lon = o.slon""",
    {"b": "SELECT lat, lon, avg(v) AS v FROM prod_b GROUP BY ALL",
     "a": _NEAR["lat"].format(src="prod_b"), "o": _NEAR["lon"].format(src="prod_b")}))
def nearest_snap_inside(v):
    """Cells outside the source range stay NULL."""
    other = v.prod_b.groupBy("lat", "lon").agg(F.avg("v").alias("other"))
    return grid.nearest_snap(v.ens.select("lat", "lon").distinct(), other, ["other"],
                             outside="null")


@query("apply_mask", sql("ens veg_mask sea_mask", f"""
    SELECT {r('e.lat', 'lat')}, {r('e.lon', 'lon')}, {d('time', 'time')}, {i('rep', 'rep')},
           {r('CASE WHEN s.m > 0 THEN CASE WHEN g.m > 0 THEN v ELSE -1 END END', 'v')}
    FROM ens e LEFT JOIN veg_mask g ON e.lat = g.lat AND e.lon = g.lon
    LEFT JOIN (SELECT lat, {WRAPPED} AS lon, m FROM sea_mask) s
         ON e.lat = s.lat AND e.lon = s.lon"""))
def apply_mask(v):
    return grid.apply_mask(v.ens, ["v"], land=v.sea_mask, vegetation=v.veg_mask,
                           sea_value=None, bare_value=-1.0)


@query("apply_mask_custom", sql("ens veg_mask", f"""
    SELECT {r('e.lat', 'lat')}, {r('e.lon', 'lon')}, {d('time', 'time')}, {i('rep', 'rep')},
           {r('CASE WHEN g.m > 0 AND v - 3 > 0 THEN v - 3 ELSE 0 END', 'v')}
    FROM ens e LEFT JOIN veg_mask g ON e.lat = g.lat AND e.lon = g.lon"""))
def apply_mask_custom(v):
    shifted = v.ens.withColumn("v", F.col("v") - 3)
    return grid.apply_mask(shifted, ["v"], custom=v.veg_mask, invalid_to_zero=True)


@query("combine_masks", sql("ens veg_mask sea_mask", f"""
    SELECT {r('e.lat', 'lat')}, {r('e.lon', 'lon')},
           {i('coalesce(s.m > 0 AND g.m > 0, false)', 'inside')}
    FROM (SELECT DISTINCT lat, lon FROM ens) e
    LEFT JOIN veg_mask g ON e.lat = g.lat AND e.lon = g.lon
    LEFT JOIN (SELECT lat, {WRAPPED} AS lon, m FROM sea_mask) s
         ON e.lat = s.lat AND e.lon = s.lon"""))
def combine_masks(v):
    return grid.combine_masks(v.ens, v.sea_mask, v.veg_mask)


@query("merge_grids", sql("ens prod_b prod_c", f"""
    SELECT {CELL}, {d('time', 'time')}, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')}
    FROM (SELECT lat, lon, time, avg(v) AS a FROM ens GROUP BY ALL)
    FULL JOIN (SELECT lat, lon, time, v AS b FROM prod_b) USING (lat, lon, time)
    FULL JOIN (SELECT lat, {WRAPPED} AS lon, time, v AS c FROM prod_c) USING (lat, lon, time)"""))
def merge_grids(v):
    return grid.merge_grids({"a": maps.rep_mean(v.ens), "b": v.prod_b,
                             "c": grid.wrapped(v.prod_c)})


@query("merge_exact", sql("ens prod_c", f"""
    SELECT {CELL}, {d('time', 'time')}, {r('a.v', 'v')}, {r('c', 'c')}
    FROM (SELECT lat, lon, time, avg(v) AS v FROM ens GROUP BY ALL) a
    JOIN (SELECT lat, {WRAPPED} AS lon, time, v AS c FROM prod_c) USING (lat, lon, time)"""))
def merge_exact(v):
    """Both grids on [-180, 180), where 180 and -180 are one meridian: values that meet in a cell once its
    longitude is wrapped are averaged, on either side."""
    left, right = (maps.rep_mean(grid.wrapped(g)) for g in (v.ens, v.prod_c))
    return grid.merge_exact(left, right.withColumnRenamed("v", "c"), ["lat", "lon", "time"])


@query("rep_mean", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {r('avg(v)', 'v')} FROM ens GROUP BY lat, lon, time"""))
def rep_mean(v):
    return maps.rep_mean(v.ens)


@query("map_mean", sql("ens", f"SELECT {CELL}, {r('avg(v)', 'mean')} FROM ens GROUP BY lat, lon"))
def map_mean(v):
    return maps.map_mean(v.ens)


_MEAN = {"e": "SELECT lat, lon, time, avg(v) AS v FROM ens GROUP BY ALL"}


@query("map_msc", sql("ens", f"""
    SELECT {CELL}, {r('(max(m) - min(m)) / 2', 'amplitude')} FROM s GROUP BY lat, lon""",
    {**_MEAN, "s": "SELECT lat, lon, month(time) AS mo, avg(v) AS m FROM e GROUP BY ALL"}))
def map_msc(v):
    return maps.map_msc(v.ens)


@query("map_anomalies", sql("ens", f"""
    SELECT {CELL}, {r('stddev_pop(a)', 'anomaly_std')} FROM a GROUP BY lat, lon""",
    {**_MEAN, "a": """SELECT lat, lon, v - avg(v) OVER (PARTITION BY lat, lon, month(time)) AS a
                      FROM e"""}))
def map_anomalies(v):
    return maps.map_anomalies(v.ens)


_ERR = {"s": """SELECT lat, lon, time, stddev_pop(v) / sqrt(count(v)) AS se FROM ens GROUP BY ALL"""}


@query("map_err", sql("ens", f"SELECT {CELL}, {r('avg(se)', 'std_err')} FROM s GROUP BY lat, lon",
                      _ERR))
def map_err(v):
    return maps.map_err(v.ens)


@query("map_err_rel", sql("ens", f"""
    SELECT {CELL}, {r('se * 100 / abs(m)', 'std_err_pct')}
    FROM (SELECT lat, lon, avg(se) AS se FROM s GROUP BY ALL)
    JOIN (SELECT lat, lon, avg(v) AS m FROM ens GROUP BY ALL) USING (lat, lon)""", _ERR))
def map_err_rel(v):
    return maps.map_err(v.ens, relative=True)


def _trend_sql(alpha):
    crit = student_critical(range(1, 31), alpha)
    table = ", ".join(f"({k}, {float(c)!r})" for k, c in enumerate(crit, 1))
    t = "abs(r * sqrt((n - 2) / (1 - r * r)))"
    return sql("ens", f"""
    SELECT {CELL}, {r(f'CASE WHEN {t} > c THEN b END', 'slope')}, {r('b', 'all_slopes')},
           {i('n', 'n_years')} FROM f LEFT JOIN (VALUES {table}) q(k, c) ON k = n - 2""", {
        **_MEAN, "y": """SELECT lat, lon, year(time) AS y, avg(v) * 372 AS a FROM e GROUP BY ALL""",
        "f": """SELECT lat, lon, regr_slope(a, y) AS b, corr(a, y) AS r, count(*) AS n
                FROM y GROUP BY lat, lon"""})


@query("map_trend", _trend_sql(0.05))
def map_trend(v):
    return maps.map_trend(v.ens)


@query("map_trend_half", _trend_sql(0.5))
def map_trend_half(v):
    """A loose significance level, so that many slopes pass."""
    return maps.map_trend(v.ens, alpha=0.5)


_REL = """SELECT lat, lon, time, avg(v) AS mean,
    stddev_pop(v) / nullif(sqrt(count(v)) * abs(avg(v)), 0) AS rel_sem FROM ens GROUP BY ALL"""


@query("rel_sem", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {r('mean', 'mean')}, {r('rel_sem', 'rel_sem')}
    FROM ({_REL})"""))
def rel_sem(v):
    return maps.rel_sem(v.ens)


_REPORTED = ", ".join(f"'{c}'" for c in REPORTED_CLASSES)


@query("rel_sem_by_class", sql("ens land_cover class_map", f"""
    SELECT {CELL}, {d('time', 'time')}, merged AS key, {r('rel_sem', 'value')}
    FROM s JOIN land_cover USING (lat, lon, time) JOIN class_map USING (code)
    WHERE merged IN ({_REPORTED})""", {"s": _REL}))
def rel_sem_by_class(v):
    return maps.rel_sem_by_class(v.ens, v.land_cover)


# ---- product comparison ------------------------------------------------------------------

_U = "(CAST('0x' || substr(md5({k}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_CELLKEY = "'{seed}|' || CAST(round(lat * 1000) AS BIGINT) || '|' || CAST(round(lon * 1000) AS BIGINT)"
_INSIDE = f"""SELECT e.lat, e.lon FROM (SELECT DISTINCT lat, lon FROM ens) e
    JOIN veg_mask g ON e.lat = g.lat AND e.lon = g.lon
    JOIN (SELECT lat, {WRAPPED} AS lon, m FROM sea_mask) s ON e.lat = s.lat AND e.lon = s.lon
    WHERE g.m > 0 AND s.m > 0"""
_DRAWN = f"""SELECT lat, lon, -ln({_U.format(k=_CELLKEY.format(seed=11))}) / cos(radians(lat)) AS key
    FROM inside ORDER BY key LIMIT 30"""
_LOCS = {"inside": _INSIDE, "drawn": _DRAWN,
         "locs": "SELECT *, row_number() OVER (ORDER BY key) - 1 AS loc FROM drawn"}


def _locations(v):
    cells = grid.combine_masks(v.ens, v.sea_mask, v.veg_mask).where("inside")
    return sample.area_sample(cells, 30, seed=11)


@query("area_sample", sql("ens veg_mask sea_mask", f"""
    SELECT {i('loc', 'loc')}, {CELL}, {r('key', 'key')} FROM locs""", _LOCS))
def area_sample(v):
    return _locations(v)


@query("area_sample_replace", sql("ens", f"""
    SELECT {i('loc', 'loc')}, {CELL} FROM u JOIN cum ON u.u >= s AND u.u < s + w""", {
    "cells": """SELECT lat, lon, cos(radians(lat)) AS w, md5('0|' || lat || '|' || lon) AS h
                FROM (SELECT DISTINCT lat, lon FROM ens)""",
    "cum": """SELECT *, coalesce(sum(w) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING), 0) AS s, sum(w) OVER () AS total FROM cells""",
    "u": f"""SELECT loc, {_U.format(k="'5|' || loc")} * (SELECT max(total) FROM cum) AS u
             FROM range(1000) t(loc)"""}))
def area_sample_replace(v):
    return sample.area_sample_with_replacement(v.ens, 1000, seed=5)


_SERIES = {
    **_LOCS,
    "alat": _NEAR["lat"].replace("ens", "locs").format(src="prod_b"),
    "alon": _NEAR["lon"].replace("ens", "locs").format(src="prod_b"),
    "sa": """SELECT loc, time, avg(v) AS a FROM locs JOIN ens USING (lat, lon) GROUP BY ALL""",
    "sb": """SELECT loc, time, v AS b FROM locs JOIN alat USING (lat) JOIN alon USING (lon)
             JOIN prod_b p ON p.lat = slat AND p.lon = slon""",
    "sc": f"""SELECT loc, time, v AS c FROM locs
              JOIN (SELECT lat, {WRAPPED} AS lon, time, v FROM prod_c) USING (lat, lon)""",
    "merged": "SELECT * FROM sa FULL JOIN sb USING (loc, time) FULL JOIN sc USING (loc, time)",
}


def _merged(v):
    return sample.compare_at_locations(_locations(v), {
        "a": v.ens, "b": v.prod_b, "c": grid.wrapped(v.prod_c)})


@query("compare_at_locations", sql("ens veg_mask sea_mask prod_b prod_c", f"""
    SELECT {i('loc', 'loc')}, {d('time', 'time')}, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')}
    FROM merged""", _SERIES))
def compare_at_locations(v):
    return _merged(v)


def _loc_r2(truth):
    return f"""SELECT loc, 1 - coalesce(sum(({truth} - a) ** 2), 0)
        / nullif(sum(({truth} - m) ** 2), 0) AS r2 FROM (
        SELECT *, avg({truth}) OVER (PARTITION BY loc) AS m FROM merged) GROUP BY loc"""


@query("loc_r2", sql("ens veg_mask sea_mask prod_b prod_c", f"""
    SELECT {i('loc', 'loc')}, {r('b.r2', 'r2_b')}, {r('c.r2', 'r2_c')}
    FROM ({_loc_r2('b')}) b JOIN ({_loc_r2('c')}) c USING (loc)""", _SERIES))
def loc_r2(v):
    return scores.location_r2(_merged(v), ["b", "c"], "a")


@query("product_ranksum", sql("ens veg_mask sea_mask prod_b prod_c", f"""
    SELECT {i('n1', 'n1')}, {i('n2', 'n2')}, {r('s', 'rank_sum')},
           {r('(s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)', 'z')}
    FROM (SELECT CAST(sum(f) AS DOUBLE) AS n1, CAST(sum(1 - f) AS DOUBLE) AS n2,
                 sum(rk * f) AS s FROM ranked)""", {
    **_SERIES, "rb": _loc_r2("b"), "rc": _loc_r2("c"),
    "pairs": """SELECT rb.r2 AS x, rc.r2 AS y FROM rb JOIN rc USING (loc)
                WHERE rb.r2 IS NOT NULL AND rc.r2 IS NOT NULL""",
    "vals": "SELECT x AS v, 1 AS f FROM pairs UNION ALL SELECT y, 0 FROM pairs",
    "ranked": """SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0
                 AS rk FROM vals"""}))
def product_ranksum(v):
    both = scores.location_r2(_merged(v), ["b", "c"], "a").dropna()
    return stats.ranksum(both, "r2_b", "r2_c", with_p=False)


#: The same at ten thousand locations, or all cells if there are fewer, as the study takes them.
_MANY = {**_SERIES,
         "inside": _INSIDE.replace("(SELECT DISTINCT lat, lon FROM ens)", "grid_cells"),
         "drawn": _DRAWN.replace("LIMIT 30", "LIMIT 10000")}
_MANY_VIEWS = "grid_cells ens veg_mask sea_mask prod_b prod_c"


def _merged_many(v):
    """Products whose cells are known are read once each."""
    shifted = v.grid_cells.select(F.round(F.col("lat") + 0.9, 3).alias("lat"),
                                  F.round(F.col("lon") - 1.1, 3).alias("lon"))
    inside = grid.combine_masks(v.grid_cells, v.sea_mask, v.veg_mask).where("inside")
    return sample.compare_at_locations(
        sample.area_sample(inside, 10_000, seed=11),
        {"a": v.ens, "b": v.prod_b, "c": grid.wrapped(v.prod_c)},
        cells={"a": v.grid_cells, "b": shifted, "c": v.grid_cells})


@query("compare_at_locations_all", sql(_MANY_VIEWS, f"""
    SELECT {i('loc', 'loc')}, {d('time', 'time')}, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')}
    FROM merged""", _MANY))
def compare_at_locations_all(v):
    return _merged_many(v)


@query("loc_r2_all", sql(_MANY_VIEWS, f"""
    SELECT {i('loc', 'loc')}, {r('b.r2', 'r2_b')}, {r('c.r2', 'r2_c')}
    FROM ({_loc_r2('b')}) b JOIN ({_loc_r2('c')}) c USING (loc)""", _MANY))
def loc_r2_all(v):
    return scores.location_r2(_merged_many(v), ["b", "c"], "a")


@query("product_ranksum_all", sql(_MANY_VIEWS, f"""
    SELECT {i('n1', 'n1')}, {i('n2', 'n2')}, {r('s', 'rank_sum')},
           {r('(s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)', 'z')}
    FROM (SELECT CAST(sum(f) AS DOUBLE) AS n1, CAST(sum(1 - f) AS DOUBLE) AS n2,
                 sum(rk * f) AS s FROM ranked)""", {
    **_MANY, "rb": _loc_r2("b"), "rc": _loc_r2("c"),
    "pairs": """SELECT rb.r2 AS x, rc.r2 AS y FROM rb JOIN rc USING (loc)
                WHERE rb.r2 IS NOT NULL AND rc.r2 IS NOT NULL""",
    "vals": "SELECT x AS v, 1 AS f FROM pairs UNION ALL SELECT y, 0 FROM pairs",
    "ranked": """SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0
                 AS rk FROM vals"""}))
def product_ranksum_all(v):
    both = scores.location_r2(_merged_many(v), ["b", "c"], "a").dropna()
    return stats.ranksum(both, "r2_b", "r2_c", with_p=False)


@query("needed_columns", sql("site_features", f"""
    SELECT {i('site', 'site')}, {d('date', 'date')}, {r('b1', 'b1')}, {r('b2', 'b2')},
           {r('"BESS-PAR"', '"BESS_PAR"')}, {r('lc', '"IGBP"')} FROM site_features"""))
def needed_columns(v):
    """Read only what a model with these features needs, under the names of the store."""
    store = v.site_features.withColumnsRenamed({"BESS-PAR": "BESS_PAR", "lc": "IGBP"})
    names = features.store_names(["b1", "b2", "BESS-PAR", "MODIS_LC_ENF", "MODIS_LC_WET"])
    return store.select("site", "date", *names).withColumn("IGBP", F.col("IGBP").cast("double"))
