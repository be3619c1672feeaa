"""Maps: one value per cell from an ensemble (lat, lon, time, rep, v).

Each map is a chain of map-side combined aggregations; central moments replace windows, so no
task ever holds all rows of a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.columns import ratio, recode
from panelgrid.functions.constants import CODE_TO_CLASS, REPORTED_CLASSES
from panelgrid.functions.distributions import student_two_sided
from panelgrid.operators.scores import sum_sq_dev

CELL = ("lat", "lon")
# Published trend maps multiply annual means of daily values by 31 days x 12 months.
TREND_FACTOR = 372.0


def rep_mean(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """Mean over repetitions per cell and time."""
    return df.groupBy(*cell, "time").agg(F.avg(value).alias(value))


def map_mean(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """Mean over all repetitions and times together."""
    return df.groupBy(*cell).agg(F.avg(value).alias("mean"))


def map_msc(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """Half the range of the mean seasonal cycle of the ensemble mean."""
    season = (rep_mean(df, value, cell).groupBy(*cell, F.month("time").alias("month"))
              .agg(F.avg(value).alias("m")))
    return season.groupBy(*cell).agg(((F.max("m") - F.min("m")) / 2).alias("amplitude"))


def map_anomalies(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """Population standard deviation of the ensemble mean around its monthly climatology."""
    within = (rep_mean(df, value, cell).groupBy(*cell, F.month("time").alias("month"))
              .agg(sum_sq_dev(value).alias("ss"), F.count(value).alias("n")))
    return within.groupBy(*cell).agg(F.sqrt(ratio(F.sum("ss"), F.sum("n"))).alias("anomaly_std"))


def map_err(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL,
            relative: bool = False) -> DataFrame:
    """Standard error over repetitions, averaged over time; ``relative`` in % of the mean."""
    per_time = df.groupBy(*cell, "time").agg(
        F.stddev_pop(value).alias("s"), F.count(value).alias("n"), F.avg(value).alias("m"))
    error = F.avg(ratio("s", F.sqrt("n")))
    if not relative:
        return per_time.groupBy(*cell).agg(error.alias("std_err"))
    pooled = ratio(F.sum(F.col("m") * F.col("n")), F.sum("n"))
    return per_time.groupBy(*cell).agg(ratio(error * 100, F.abs(pooled)).alias("std_err_pct"))


def map_trend(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL,
              factor: float = TREND_FACTOR, alpha: float = 0.05,
              with_p: bool = False) -> DataFrame:
    """Slope per year of the annual ensemble mean where it is significant, else NULL.

    The p-value of each cell is a column expression, so the plan stays in the JVM; ``with_p`` returns it.
    A perfect line has p = 0; two years that differ are one, too. A flat series has p = 1.
    """
    year = F.year("time").cast("double")
    annual = (rep_mean(df, value, cell).groupBy(*cell, year.alias("year"))
              .agg((F.avg(value) * factor).alias("a")))
    fit = annual.groupBy(*cell).agg(
        F.regr_slope("a", "year").alias("all_slopes"), F.regr_count("a", "year").alias("n_years"),
        F.regr_sxx("a", "year").alias("sxx"), F.regr_sxy("a", "year").alias("sxy"),
        F.regr_syy("a", "year").alias("syy"))
    dof = F.col("n_years") - 2
    unexplained = F.greatest(F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), "sxx"), F.lit(0.0))
    # residual sum of squares 0: a perfect line, infinitely significant unless it is flat
    t = F.when((unexplained == 0) & (F.col("sxy") != 0), F.lit(float("inf"))).otherwise(
        F.abs(F.col("all_slopes")) * F.sqrt(ratio(F.col("sxx") * dof, unexplained)))
    p = F.when(t == float("inf"), F.lit(0.0)).otherwise(
        F.coalesce(student_two_sided(t, dof), F.lit(1.0)))
    out = fit.withColumn("p_value", p).withColumn("slope", F.when(
        F.col("p_value") < alpha, F.col("all_slopes")))
    return out.select(*cell, "slope", "all_slopes", "n_years", *(["p_value"] if with_p else []))


def rel_sem(df: DataFrame, value: str = "v", cell: Sequence[str] = CELL) -> DataFrame:
    """Ensemble mean and relative standard error per cell and time."""
    err = ratio(F.stddev_pop(value), F.sqrt(F.count(value)) * F.abs(F.avg(value)))
    return df.groupBy(*cell, "time").agg(F.avg(value).alias("mean"), err.alias("rel_sem"))


def rel_sem_by_class(df: DataFrame, land_cover: DataFrame, value: str = "v",
                     cell: Sequence[str] = CELL, code: str = "code") -> DataFrame:
    """Relative standard errors keyed by land-cover class, reported classes only.

    A cell without a code counts as code 0 and is not reported.
    """
    keys = [*cell, "time"]
    j = rel_sem(df, value, cell).join(land_cover.select(*keys, code), keys, "left")
    klass = recode(F.coalesce(F.col(code), F.lit(0)).cast("int"), CODE_TO_CLASS)
    return (j.select(*keys, klass.alias("key"), F.col("rel_sem").alias("value"))
            .where(F.col("key").isin(REPORTED_CLASSES)))
