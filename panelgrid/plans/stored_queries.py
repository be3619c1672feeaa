"""Maps of stored cubes: bucketed tables, merged moments, array tiles; and density level sets."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from panelgrid.operators import grid, maps, moments, summarize, tiles
from panelgrid.plans.grid_queries import CELL, WRAPPED, _ERR
from panelgrid.plans.registry import d, i, query, r
from panelgrid.plans.views import sql
from panelgrid.session import scratch_path
from panelgrid.sources import stored


def _stored(v, name, df, buckets=4):
    return stored.store_by_cell(df, f"{name}_{uuid4().hex}", scratch_path(v.spark, name), buckets)


@query("map_mean_stored", sql("ens", f"SELECT {CELL}, {r('avg(v)', 'mean')} FROM ens GROUP BY lat, lon"))
def map_mean_stored(v):
    return stored.in_degrees(maps.map_mean(_stored(v, "ens", v.ens), cell=stored.STORED_CELL))


@query("merge_grids_stored", sql("ens prod_b prod_c", f"""
    SELECT {CELL}, {d('time', 'time')}, {r('a', 'a')}, {r('b', 'b')}, {r('c', 'c')}
    FROM (SELECT lat, lon, time, avg(v) AS a FROM ens GROUP BY ALL)
    FULL JOIN (SELECT lat, lon, time, v AS b FROM prod_b) USING (lat, lon, time)
    FULL JOIN (SELECT lat, {WRAPPED} AS lon, time, v AS c FROM prod_c) USING (lat, lon, time)"""))
def merge_grids_stored(v):
    parts = {"a": v.ens, "b": v.prod_b, "c": grid.wrapped(v.prod_c)}
    return stored.merge_stored({n: _stored(v, n, df) for n, df in parts.items()})


def _merged(v):
    """Six repetitions first, then the seventh."""
    path = scratch_path(v.spark, "moments")
    stored.merge_repetitions(v.ens.where("rep <= 6"), path)
    return stored.merge_repetitions(v.ens.where("rep > 6"), path)


@query("map_err_merged", sql("ens", f"""
    SELECT {CELL}, {r('avg(se)', 'std_err')} FROM s GROUP BY lat, lon""", _ERR))
def map_err_merged(v):
    return moments.map_err(_merged(v))


@query("map_trend_merged", sql("ens", f"""
    SELECT {CELL}, {r('regr_slope(a, y)', 'all_slopes')}, {i('count(*)', 'n_years')}
    FROM (SELECT lat, lon, year(time) AS y, avg(v) * 372 AS a FROM (
        SELECT lat, lon, time, avg(v) AS v FROM ens GROUP BY ALL) GROUP BY ALL) GROUP BY lat, lon"""))
def map_trend_merged(v):
    return maps.map_trend(moments.ensemble_mean(_merged(v))).drop("slope")


#: The cells of the views, seven by eleven to a tile.
TILING = tiles.Tiling(-47.5, 5.0, -180.0, 7.2, 7, 11)
_PLACED = f"""SELECT time, rep, v, CAST(round((lat + 47.5) / 5.0) AS INT) AS y,
    CAST(round((lon + 180) / 7.2) AS INT) AS x FROM ens"""


@query("cube_tiles", sql("ens", f"""
    SELECT {d('time', 'time')}, {i('rep', 'rep')}, {i('y // 7', 'ty')}, {i('x // 11', 'tx')},
           {i('77', 'cells')}, {i('count(*)', 'known')}, {r('sum(v)', 'total')},
           {r('sum(v * (1 + (y % 7) * 11 + x % 11))', 'placed')} FROM p GROUP BY ALL""", {"p": _PLACED}))
def cube_tiles(v):
    """Tiles with their sum and their sum weighted by place, which tells where each value lies."""
    t = tiles.cube_tiles(v.ens, TILING)
    add = lambda s, c: s + F.coalesce(c, F.lit(0.0))
    return t.select("time", "rep", "ty", "tx", F.size("cells").alias("cells"),
                    F.size(F.array_compact("cells")).alias("known"),
                    F.aggregate("cells", F.lit(0.0), add).alias("total"),
                    F.aggregate(F.transform("cells", lambda c, at: c * (at + 1)), F.lit(0.0), add).alias("placed"))


@query("tiles_to_long", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {i('rep', 'rep')}, {r('v', 'v')} FROM ens"""))
def tiles_to_long(v):
    return tiles.tiles_to_long(tiles.cube_tiles(v.ens, TILING), TILING)


@query("tile_mean", sql("ens", f"""
    SELECT {CELL}, {d('time', 'time')}, {r('avg(v)', 'v')} FROM ens GROUP BY lat, lon, time"""))
def tile_mean(v):
    mean = tiles.tile_mean(tiles.cube_tiles(v.ens, TILING))
    return tiles.tiles_to_long(mean, TILING, ["time"])


_REACH = 12  # 4 bandwidths of 1.5 in steps of 0.5
_LEVELS = {
    "pts": "SELECT rep, gt / 0.5 AS u, pred / 0.5 AS v FROM site_month_rep",
    "n0": """SELECT rep, floor(u) + a AS ix, floor(v) + b AS iy,
        sum((CASE WHEN a = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END)
          * (CASE WHEN b = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END)) AS w
        FROM pts, (VALUES (0), (1)) t(a), (VALUES (0), (1)) s(b) GROUP BY ALL HAVING w > 0""",
    "k": f"""SELECT o, g / sum(g) OVER () AS g FROM (SELECT range - {_REACH} AS o,
        exp(-(((range - {_REACH}) * 0.5 / 1.5) ** 2) / 2) AS g FROM range({2 * _REACH + 1}))""",
    "n1": "SELECT rep, ix + o AS ix, iy, sum(w * g) AS w FROM n0, k GROUP BY ALL",
    "n2": "SELECT rep, ix, iy + o AS iy, sum(w * g) AS w FROM n1, k GROUP BY ALL",
    "c": """SELECT rep, w, sum(w) OVER (PARTITION BY rep ORDER BY w DESC) AS above,
        count(*) OVER (PARTITION BY rep ORDER BY w DESC) AS cells, sum(w) OVER (PARTITION BY rep) AS total
        FROM n2"""}


@query("density_levels", sql("site_month_rep", f"""
    SELECT {i('rep', 'rep')}, {r('level', 'level')}, {r('w / (total * 0.25)', 'threshold')},
           {i('cells', 'cells')}, {r('above / total', 'mass')}
    FROM (SELECT *, row_number() OVER (PARTITION BY rep, level ORDER BY w DESC) AS k
          FROM c, (VALUES (0.25), (0.5), (0.75)) l(level)
          WHERE above >= (1 - level) * total * (1 - 1e-12)) WHERE k = 1""", _LEVELS))
def density_levels(v):
    """Contours of the joint density of truth and prediction, per repetition."""
    return summarize.density_levels(v.site_month_rep, "gt", "pred", 0.5, 1.5, by=["rep"])
