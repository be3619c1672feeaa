"""Grids as long tables (lat, lon, time, value): alignment, masks, merging, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import round_coord, wrap_lon
from panelgrid.operators.grouping import join_reduced, known_neighbours
from panelgrid.session import pin

CELL = ("lat", "lon")
# Coordinates of a band of so many degrees are sorted together.
BAND = 1.0


def rounded(df: DataFrame, decimals: int = 3, cell: Sequence[str] = CELL) -> DataFrame:
    """Coordinates rounded so that grids of different files meet."""
    return df.withColumns({c: round_coord(c, decimals) for c in cell})


def wrapped(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Longitudes in [-180, 180), freed from the last-digit noise of the wrap."""
    return df.withColumn(lon, F.round(wrap_lon(lon), 9))


def grid_stride(df: DataFrame, step: int = 5, cell: Sequence[str] = CELL,
                cells: DataFrame | None = None) -> DataFrame:
    """Every ``step``-th value of each sorted axis.

    Only the distinct coordinates of the axes are numbered, band by band: those of a band by themselves,
    the bands by how many coordinates lie below. They are taken from ``cells``, the table of grid cells,
    or else from the data, which are then read once more.
    """
    axes = df if cells is None else cells
    values = pin(axes.select(*cell).distinct(), "axes") if cells is None else axes
    for c in cell:
        axis = values.select(c).distinct().withColumn("_band", F.floor(F.col(c) / BAND))
        below = F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))
        bands = axis.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).select(
            "_band", F.coalesce(below, F.lit(0)).alias("_below"))
        nth = F.col("_below") + F.row_number().over(Window.partitionBy("_band").orderBy(c)) - 1
        keep = axis.join(bands, "_band").withColumn("_i", nth).where(F.col("_i") % step == 0)
        df = join_reduced(df, keep.select(c), [c], "left_semi")
    return df


def snap_axis(targets: DataFrame, sources: DataFrame, axis: str, outside: str = "clamp",
              out: str = "snapped", period: float | None = None) -> DataFrame:
    """Nearest source coordinate of each target coordinate on one axis.

    Both axes are merged in order and each target looks at the source before and after it, so
    no pairs are formed. Only coordinates of one band meet in a window, the nearest ones of other bands
    are carried over (``known_neighbours``). Ties go to the larger coordinate. Outside the source
    range ``clamp`` takes the edge and ``null`` gives NULL. ``period`` (360 for longitudes)
    repeats the source axis on both sides.
    """
    t = targets.select(F.col(axis).alias("_p")).distinct()
    s = sources.select(F.col(axis).alias("_v")).distinct()
    at: list[Column] = [F.col("_v")]
    if period:
        at = [F.col("_v") - period, F.col("_v"), F.col("_v") + period]
    marks = s.select(F.explode(F.array(*at)).alias("_p"), "_v")
    points = (marks.select("_p", F.struct(F.col("_p").alias("p"), F.col("_v").alias("v")).alias("_s"),
                           F.lit(0).alias("_t"))
              .unionByName(t.select("_p", F.lit(1).alias("_t")), allowMissingColumns=True)
              .groupBy("_p").agg(F.max("_s").alias("_s"), F.max("_t").alias("_t")))
    n = known_neighbours(points, ["_s"], ["_p"], F.floor(F.col("_p") / BAND)).select(
        "_p", "_t", F.col("prev__s").alias("_lo"), F.col("next__s").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    nearer = F.when((F.col("_p") - lo["p"]) < (hi["p"] - F.col("_p")), lo["v"]).otherwise(hi["v"])
    one_sided = F.coalesce(lo["v"], hi["v"]) if outside == "clamp" else F.lit(None).cast("double")
    pick = F.when(lo.isNotNull() & hi.isNotNull(), nearer).otherwise(one_sided)
    return n.where(F.col("_t") == 1).select(F.col("_p").alias(axis), pick.alias(out))


def nearest_snap(targets: DataFrame, source: DataFrame, values: Sequence[str],
                 on: Sequence[str] = (), outside: str = "clamp", wrap: bool = False,
                 how: str = "left", cell: Sequence[str] = CELL,
                 cells: DataFrame | None = None,
                 source_cells: DataFrame | None = None) -> DataFrame:
    """Value of the nearest source cell for every target row.

    Nearest is taken per axis, so two small axis tables replace a cell-by-cell distance join.
    ``on`` lists further equal keys such as time. ``cells`` and ``source_cells`` name the cells
    of the two grids where they are known; otherwise each table is read once more for its cells.
    """
    lat, lon = cell
    # both axes come from one pass over each table
    t = pin(targets.select(*cell).distinct(), "cells") if cells is None else cells
    s = pin(source.select(*cell).distinct(), "cells") if source_cells is None else source_cells
    lat_map = snap_axis(t, s, lat, outside)
    lon_map = snap_axis(t, s, lon, outside, period=360.0 if wrap else None)
    # both small maps in one pinned table
    axes = pin(lat_map.select(F.lit("lat").alias("_axis"), F.col(lat).alias("_at"), "snapped")
               .unionByName(lon_map.select(F.lit("lon").alias("_axis"), F.col(lon).alias("_at"),
                                           "snapped")), "axes")
    located = targets
    for name, c in (("lat", lat), ("lon", lon)):
        part = axes.where(F.col("_axis") == name).select(
            F.col("_at").alias(c), F.col("snapped").alias(f"_s{name}"))
        located = located.join(part, c, "left")
    src = source.select(F.col(lat).alias("_slat"), F.col(lon).alias("_slon"), *on, *values)
    keep = [c for c in targets.columns]
    return located.join(src, ["_slat", "_slon", *on], how).select(*keep, *values)


def masked(value: Column | str, cond: Column, fill: float | None = None) -> Column:
    """``value`` where ``cond`` holds, else ``fill``; an unknown condition counts as not held."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(cond, v).otherwise(F.lit(fill).cast("double"))


def apply_mask(df: DataFrame, values: Sequence[str], land: DataFrame | None = None,
               vegetation: DataFrame | None = None, sea_value: float | None = 0.0,
               bare_value: float | None = 0.0, custom: DataFrame | None = None,
               custom_value: float | None = None, invalid_to_zero: bool = False,
               cells: DataFrame | None = None) -> DataFrame:
    """Replace cells outside the masks: vegetation, then land, then custom, then invalid.

    Mask tables are (lat, lon, m); a cell counts as inside where ``m`` > 0. Vegetation and land
    masks are taken at the nearest mask cell (none outside their range), the land mask with its
    longitudes wrapped first; a custom mask must share the grid. ``cells`` is the table of grid
    cells; without it the distinct cells of ``df`` are pinned, at the price of one more pass.
    """
    if cells is None and (land is not None or vegetation is not None):
        cells = pin(df.select(*CELL).distinct(), "cells")
    steps = []
    if vegetation is not None:
        steps.append((nearest_snap(cells, vegetation, ["m"], outside="null"), bare_value))
    if land is not None:
        steps.append((nearest_snap(cells, wrapped(land), ["m"], outside="null"), sea_value))
    if custom is not None:
        steps.append((custom.select(*CELL, "m"), custom_value))
    if steps:
        flags = None
        for k, (m, _) in enumerate(steps):
            m = m.withColumnRenamed("m", f"_m{k}")
            flags = m if flags is None else flags.join(m, list(CELL), "full_outer")
        # all masks meet in one small table, so the big one is joined once
        df = df.join(pin(flags, "masks"), list(CELL), "left")
        for k, (_, fill) in enumerate(steps):
            df = df.withColumns({v: masked(v, F.col(f"_m{k}") > 0, fill) for v in values})
        df = df.drop(*[f"_m{k}" for k in range(len(steps))])
    if invalid_to_zero:
        df = df.withColumns({v: masked(v, F.col(v) > 0, 0.0) for v in values})
    return df


def combine_masks(targets: DataFrame, land: DataFrame, vegetation: DataFrame) -> DataFrame:
    """Target cells with a flag: land and vegetated at the nearest mask cells."""
    cells = pin(targets.select(*CELL).distinct(), "cells")
    v = nearest_snap(cells, vegetation, ["m"], outside="null").withColumnRenamed("m", "_v")
    s = nearest_snap(cells, wrapped(land), ["m"], outside="null").withColumnRenamed("m", "_s")
    inside = F.coalesce((F.col("_v") > 0) & (F.col("_s") > 0), F.lit(False))
    return v.join(s, list(CELL)).select(*CELL, inside.alias("inside"))


def merge_grids(grids: Mapping[str, DataFrame], keys: Sequence[str] = ("lat", "lon", "time"),
                value: str = "v") -> DataFrame:
    """Many one-variable grids side by side, cells of any grid kept.

    One union and one shuffle, instead of a chain of outer joins. Several values of a cell, such
    as repetitions, are averaged on the way.
    """
    long = reduce(DataFrame.unionByName, [
        g.select(*keys, F.lit(n).alias("_var"), F.col(value).alias("_x"))
        for n, g in grids.items()])
    return long.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("_var") == n, F.col("_x"))).alias(n) for n in grids])


def merge_exact(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Side by side, failing when a key is on one side only."""
    keys = list(keys)
    both = (left.withColumn("_l", F.lit(1))
            .join(right.withColumn("_r", F.lit(1)), keys, "full_outer"))
    whole = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(),
                          F.lit("grids differ in their keys"))
    # the check runs with the join itself; assert_true yields NULL when it holds
    return both.where(whole.isNull()).drop("_l", "_r")


def time_slice(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Dates from start to end, both included."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))


def month_of_year(df: DataFrame, month: int, time: str = "time") -> DataFrame:
    return df.where(F.month(time) == month)


def resample_monthly(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                     time: str = "time", fill_gaps: bool = False) -> DataFrame:
    """Calendar-month means stamped with the month end.

    ``fill_gaps`` adds the empty months between the first and last month of the whole table.
    """
    keys = list(keys)
    month = F.last_day(time)
    out = df.groupBy(*keys, month.alias(time)).agg(*[F.avg(v).alias(v) for v in values])
    if not fill_gaps:
        return out
    ends = df.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    # one scalar row for the range; each key then spans it
    span = F.sequence(F.trunc(ends.select("a").scalar(), "month"),
                      F.trunc(ends.select("b").scalar(), "month"), F.expr("INTERVAL 1 MONTH"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(span).alias("_m"))
    return grid.select(*keys, F.last_day("_m").alias(time)).join(out, keys + [time], "left")


def resample_yearly(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                    time: str = "time") -> DataFrame:
    """Calendar-year means stamped with 31 December."""
    end = F.make_date(F.year(time), F.lit(12), F.lit(31))
    return df.groupBy(*keys, end.alias(time)).agg(*[F.avg(v).alias(v) for v in values])
