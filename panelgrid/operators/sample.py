"""Area-weighted samples of grid cells and product comparison at them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import uniform
from panelgrid.operators.grid import merge_grids, snap_axis
from panelgrid.operators.grouping import join_reduced, pick_by_draw, weighted_positions
from panelgrid.session import pin


def _weight(lat: str):
    return F.cos(F.radians(lat))


def area_sample(cells: DataFrame, n: int, seed: int = 0, lat: str = "lat",
                lon: str = "lon") -> DataFrame:
    """``n`` different cells, likelier where a cell covers more area (cosine of latitude).

    Each cell gets the key -ln(u) / weight and the smallest keys win, which is one top-n.
    Only the ``n`` winners are then numbered as ``loc``.
    """
    u = uniform(seed, F.round(F.col(lat) * 1000).cast("bigint"),
                F.round(F.col(lon) * 1000).cast("bigint"))
    key = -F.log(u) / _weight(lat)
    winners = (cells.where(_weight(lat) > 0).select(lat, lon).distinct()
               .withColumn("key", key).orderBy("key", lat, lon).limit(n))
    loc = F.row_number().over(Window.orderBy("key", lat, lon)) - 1
    return winners.select(loc.cast("bigint").alias("loc"), lat, lon, "key")


def area_sample_with_replacement(cells: DataFrame, n: int, seed: int = 0, lat: str = "lat",
                                 lon: str = "lon") -> DataFrame:
    """``n`` draws with replacement, one row per draw: ``loc``, lat, lon."""
    items = (cells.where(_weight(lat) > 0).select(lat, lon).distinct()
             .withColumn("_w", _weight(lat)))
    placed = pin(weighted_positions(items, [lat, lon], "_w"), "positions")
    total = placed.agg(F.max("total")).scalar()
    draws = (cells.sparkSession.range(n).withColumnRenamed("id", "loc")
             .withColumn("total", total))
    draws = draws.withColumn("u", uniform(seed, "loc") * F.col("total"))
    return pick_by_draw(placed, [lat, lon], draws.select("u", "total", "loc"))


def at_locations(locations: DataFrame, product: DataFrame, value: str = "v",
                 wrap: bool = False, cells: DataFrame | None = None) -> DataFrame:
    """Rows of the nearest product cell at each location: loc, time, value.

    The product is cut down to the wanted cells by an equi-join on its own coordinates. ``cells`` is the
    table of its cells; without it they are read from the product, once for both axes.
    """
    cells = pin(product.select("lat", "lon").distinct(), "cells") if cells is None else cells
    lat_map = snap_axis(locations, cells, "lat", "clamp", "_slat")
    lon_map = snap_axis(locations, cells, "lon", "clamp", "_slon", 360.0 if wrap else None)
    located = (locations.join(lat_map, "lat").join(lon_map, "lon")
               .select("loc", F.col("_slat").alias("lat"), F.col("_slon").alias("lon")))
    cut = join_reduced(product.select("lat", "lon", "time", value), located, ["lat", "lon"],
                       "inner")
    return cut.select("loc", "time", value)


def compare_at_locations(locations: DataFrame, products: Mapping[str, DataFrame],
                         value: str = "v", wrap: bool = False,
                         cells: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All products side by side at the sampled locations, any of them possibly missing.

    Ensembles may be given with their repetitions; cells are selected first and averaged then,
    in the one shuffle that lines the products up. A product whose cells are given is read once.
    """
    locations, cells = pin(locations, "locations"), cells or {}
    series = {n: at_locations(locations, p, value, wrap, cells.get(n)) for n, p in products.items()}
    return merge_grids(series, ["loc", "time"], value)
