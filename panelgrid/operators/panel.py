"""Panel series (site x month): season, anomaly, trend, gap filling, length filters.

A panel has one row per site and date. All statistics come from one table of month moments
(at most twelve rows per site) that Spark combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.columns import month_index, ratio
from panelgrid.operators.grouping import attach_stats, join_reduced, known_neighbours

SITE = ("site",)


def _month(date: str) -> Column:
    return F.month(date).alias("month")


def annual_mean(df: DataFrame, value: str, keys: Sequence[str] = SITE, date: str = "date",
                transform: bool = False) -> DataFrame:
    """Mean per site and year, or that mean on every row."""
    if transform:
        return (attach_stats(df.withColumn("year", F.year(date)), [*keys, "year"],
                             annual_mean=F.avg(value)).drop("year"))
    return df.groupBy(*keys, F.year(date).alias("year")).agg(F.avg(value).alias("annual_mean"))


def across_site_variability(df: DataFrame, values: Sequence[str],
                            keys: Sequence[str] = SITE) -> DataFrame:
    """Mean per site of each value."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def across_site_trend(df: DataFrame, values: Sequence[str], keys: Sequence[str] = SITE,
                      date: str = "date") -> DataFrame:
    """Slope per month of the raw value for each site; 0 for a site with a single date.

    The values are not turned into month totals first: slopes are per month of the daily value.
    """
    x = month_index(date)
    return df.groupBy(*keys).agg(
        *[F.when(F.count(v) > 0, F.coalesce(F.regr_slope(v, x), F.lit(0.0))).alias(v)
          for v in values])


def msc(df: DataFrame, value: str, keys: Sequence[str] = SITE, date: str = "date",
        transform: bool = False, no_mean: bool = False) -> DataFrame:
    """Mean seasonal cycle: mean per site and month of the year.

    ``no_mean`` first removes the site mean, which equals subtracting it from each month mean.
    """
    season = df.groupBy(*keys, _month(date)).agg(F.avg(value).alias("msc"),
                                                 F.count(value).alias("_n"))
    if no_mean:
        # at most twelve rows per site
        w = Window.partitionBy(*keys)
        site_mean = ratio(F.sum(F.col("msc") * F.col("_n")).over(w), F.sum("_n").over(w))
        season = season.withColumn("msc", F.col("msc") - site_mean)
    season = season.drop("_n")
    if not transform:
        return season
    return (join_reduced(df.withColumn("month", F.month(date)), season, [*keys, "month"])
            .drop("month"))


def _season_and_slope(df, value, keys, date):
    """Per site and month: season mean; per site: slope and centre of the de-seasoned series.

    Deviations from a month mean sum to zero within the month, so their covariance with time over
    the site is the sum of the within-month covariances.
    """
    x = month_index(date)
    m = df.groupBy(*keys, _month(date)).agg(
        F.avg(value).alias("_season"),
        F.regr_count(value, x).alias("_n"),
        F.regr_avgx(value, x).alias("_mx"),
        F.regr_sxx(value, x).alias("_sxx"),
        F.regr_sxy(value, x).alias("_sxy"),
    )
    w = Window.partitionBy(*keys)  # at most twelve rows
    m = m.withColumn("_x0", ratio(F.sum(F.col("_n") * F.col("_mx")).over(w), F.sum("_n").over(w)))
    spread = F.col("_sxx") + F.col("_n") * F.pow(F.col("_mx") - F.col("_x0"), F.lit(2))
    slope = ratio(F.sum("_sxy").over(w), F.sum(spread).over(w))
    return m.select(*keys, "month", "_season", "_x0",
                    F.coalesce(slope, F.lit(0.0)).alias("_slope"))


def iav(df: DataFrame, value: str, keys: Sequence[str] = SITE, date: str = "date",
        detrend: bool = False, out: str = "iav") -> DataFrame:
    """Anomaly: value minus its season, optionally minus the line fitted to that difference."""
    stats = _season_and_slope(df, value, keys, date)
    j = join_reduced(df.withColumn("month", F.month(date)), stats, [*keys, "month"])
    anomaly = F.col(value) - F.col("_season")
    if detrend:
        anomaly = anomaly - F.col("_slope") * (month_index(date) - F.col("_x0"))
    return j.withColumn(out, anomaly).drop("month", "_season", "_x0", "_slope")


def trend(df: DataFrame, value: str, keys: Sequence[str] = SITE, date: str = "date",
          out: str = "trend") -> DataFrame:
    """The fitted line on every row that has a value."""
    x = month_index(date)
    j = attach_stats(df, keys, _slope=F.coalesce(F.regr_slope(value, x), F.lit(0.0)),
                     _x0=F.regr_avgx(value, x), _y0=F.avg(value))
    line = F.col("_y0") + F.col("_slope") * (x - F.col("_x0"))
    return (j.withColumn(out, F.when(F.col(value).isNotNull(), line))
            .drop("_slope", "_x0", "_y0"))


def gap_fill(df: DataFrame, values: Sequence[str], keys: Sequence[str] = SITE,
             date: str = "date") -> DataFrame:
    """Fill a gap with the mean of the closest known values before and after it.

    Consecutive gaps share one value; leading and trailing gaps stay NULL. Works year by year
    with the edge values carried across years.
    """
    n = known_neighbours(df, values, [date], F.year(date), keys)
    filled = {v: F.coalesce(F.col(v), (F.col(f"prev_{v}") + F.col(f"next_{v}")) / 2)
              for v in values}
    return n.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def series_length(df: DataFrame, value: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Number of known values of the site on every row."""
    return attach_stats(df, keys, series_length=F.count(value))


def min_months(df: DataFrame, value: str, at_least: int, keys: Sequence[str] = SITE) -> DataFrame:
    """Rows of sites with at least that many known values."""
    long_enough = (df.groupBy(*keys).agg(F.count(value).alias("_n"))
                   .where(F.col("_n") >= at_least).select(*keys))
    return join_reduced(df, long_enough, keys, "left_semi")


def drop_empty_dates(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Drop dates at which no site has the value."""
    dates = df.where(F.col(value).isNotNull()).select(date).distinct()
    return join_reduced(df, dates, [date], "left_semi")


def class_changed(df: DataFrame, value: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Keys whose class takes more than one value."""
    # min <> max says the same as a distinct count above one, without expanding rows
    return (df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
            .where(F.col("_a") != F.col("_b")).select(*keys))


def last_per_site(df: DataFrame, values: Sequence[str], keys: Sequence[str] = SITE,
                  date: str = "date") -> DataFrame:
    """Values of the latest date of each site, NULL kept."""
    return df.groupBy(*keys).agg(*[F.max_by(v, date).alias(v) for v in values])


def first_known(df: DataFrame, values: Sequence[str], keys: Sequence[str] = SITE,
                date: str = "date") -> DataFrame:
    """First known value of each column in date order."""
    return df.groupBy(*keys).agg(
        *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(date))).alias(v) for v in values])


def available_months(df: DataFrame, keys: Sequence[str] = SITE, date: str = "date") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(date).alias("avail_months"))
