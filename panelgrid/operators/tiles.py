"""Cubes as dense array tiles: a row holds a block of cells of one time as an array.

A cell's row and column follow from its coordinates, its tile and place in the tile from these, all by
arithmetic. Tiles without any value are not stored; missing cells of a stored tile are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiling:
    """A regular grid from its first cell and steps, cut into tiles of ``height`` x ``width`` cells."""

    lat0: float
    lat_step: float
    lon0: float
    lon_step: float
    height: int = 720
    width: int = 360

    @property
    def cells(self) -> int:
        return self.height * self.width


def cube_tiles(df: DataFrame, t: Tiling, keys: Sequence[str] = ("time", "rep"), value: str = "v") -> DataFrame:
    """(keys, ty, tx, cells): cells row by row, NULL where there is none. Cells off the grid go to the
    nearest grid cell; of several values of a cell the mean is stored."""
    y = F.rint((F.col("lat") - t.lat0) / t.lat_step).cast("int")
    x = F.rint((F.col("lon") - t.lon0) / t.lon_step).cast("int")
    tile = [F.floor(y / t.height).cast("int").alias("ty"), F.floor(x / t.width).cast("int").alias("tx")]
    place = (F.pmod(y, F.lit(t.height)) * t.width + F.pmod(x, F.lit(t.width))).alias("place")
    cells = (df.where(F.col(value).isNotNull()).groupBy(*keys, *tile, place).agg(F.avg(value).alias("_v")))
    # a tile is one row however it is stored, so its cells meet in one place
    sparse = cells.groupBy(*keys, "ty", "tx").agg(F.sort_array(F.collect_list(F.struct(
        "place", "_v"))).alias("s"))
    nulls = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    before = F.transform("s", lambda c, i: F.concat(
        nulls(c["place"] - F.when(i > 0, F.get("s", i - 1)["place"]).otherwise(-1) - 1), F.array(c["_v"])))
    rest = nulls(t.cells - 1 - F.element_at("s", -1)["place"])
    return sparse.select(*keys, "ty", "tx", F.concat(F.flatten(before), rest).alias("cells"))


def tiles_to_long(tiles: DataFrame, t: Tiling, keys: Sequence[str] = ("time", "rep"), value: str = "v",
                  decimals: int = 3) -> DataFrame:
    """(lat, lon, keys, value) of the cells that have one."""
    cells = tiles.select(*keys, "ty", "tx", F.posexplode("cells").alias("place", value)).where(
        F.col(value).isNotNull())
    y = F.col("ty") * t.height + F.floor(F.col("place") / t.width)
    x = F.col("tx") * t.width + F.col("place") % t.width
    return cells.select(F.round(t.lat0 + y * t.lat_step, decimals).alias("lat"),
                        F.round(t.lon0 + x * t.lon_step, decimals).alias("lon"), *keys, value)


def _over_rows(op) -> Column:
    """Cell by cell over the tiles of a group; ``op`` combines two values that are not NULL."""
    def add(s, c):
        return F.zip_with(s, c, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(op(a, b)))

    rows = F.collect_list("cells")
    return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), F.get(rows, F.lit(0)), add)


def tile_mean(tiles: DataFrame, over: str = "rep", keys: Sequence[str] = ("time",)) -> DataFrame:
    """Mean over ``over`` (repetitions, or the months of a year) of each cell, tile by tile.

    Meant for a bounded number of tiles per group, as a study has of repetitions: they meet as arrays.
    """
    known = F.transform("cells", lambda c: F.when(c.isNotNull(), F.lit(1.0)))
    both = tiles.drop(over).withColumn("cells", F.arrays_zip("cells", known.alias("n")))
    pairs = both.select(*keys, "ty", "tx", F.transform("cells", lambda c: F.when(
        c["n"].isNotNull(), F.struct(c["cells"].alias("v"), c["n"].alias("n")))).alias("cells"))
    total = _over_rows(lambda a, b: F.struct((a["v"] + b["v"]).alias("v"), (a["n"] + b["n"]).alias("n")))
    return pairs.groupBy(*keys, "ty", "tx").agg(total.alias("cells")).withColumn(
        "cells", F.transform("cells", lambda c: c["v"] / c["n"]))
