"""Maps from moments per cell and time, which merge when a repetition is added.

The moments are n, mean and m2 (the sum of squares around the mean). Two tables of them merge without the
values they came from, and no large number is squared and subtracted on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.columns import ratio
from panelgrid.operators.maps import CELL
from panelgrid.operators.scores import sum_sq_dev


def ensemble_moments(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """n, mean and m2 over the repetitions of each cell and time; a cell without a value has n = 0."""
    return df.groupBy(*cell, "time").agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                         sum_sq_dev(value).alias("m2"))


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = (*CELL, "time")) -> DataFrame:
    """Moments of the rows behind both tables; keys of only one of them are kept."""
    keys = list(keys)
    left = a.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "mean", "m2")])
    both = left.join(b.select(*keys, "n", "mean", "m2"), keys, "full_outer")
    n1, n2 = F.coalesce("_n", F.lit(0)), F.coalesce("n", F.lit(0))
    n = n1 + n2
    apart = F.col("mean") - F.col("_mean")
    mean = F.when(n1 == 0, F.col("mean")).when(n2 == 0, F.col("_mean")).otherwise(
        F.col("_mean") + apart * ratio(n2, n))
    between = F.coalesce(apart * apart * ratio(n1 * n2, n), F.lit(0.0))
    m2 = F.coalesce("_m2", F.lit(0.0)) + F.coalesce("m2", F.lit(0.0)) + between
    return both.select(*keys, n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def ensemble_mean(m: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """The ensemble mean per cell and time, which seasons, trends and anomalies are maps of."""
    return m.select(*cell, "time", F.col("mean").alias(value))


def map_mean(m: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    return m.groupBy(*cell).agg(ratio(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("mean"))


def map_err(m: DataFrame, cell: Sequence[str] = CELL, relative: bool = False) -> DataFrame:
    """Standard error over repetitions, averaged over time; ``relative`` in % of the mean."""
    error = F.avg(ratio(F.sqrt(ratio("m2", "n")), F.sqrt("n")))
    if not relative:
        return m.groupBy(*cell).agg(error.alias("std_err"))
    pooled = ratio(F.sum(F.col("mean") * F.col("n")), F.sum("n"))
    return m.groupBy(*cell).agg(ratio(error * 100, F.abs(pooled)).alias("std_err_pct"))
