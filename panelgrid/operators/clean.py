"""Cleaning of site records: recoding, patches, quality filters, dimension joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.columns import month_end, recode
from panelgrid.operators.panel import available_months, last_per_site


def with_month_end(df: DataFrame, year: str = "year", month: str = "month",
                   out: str = "date") -> DataFrame:
    """Replace year and month numbers by the month-end date."""
    return df.withColumn(out, month_end(year, month)).drop(year, month)


def recode_column(df: DataFrame, column: str, mapping: Mapping, keep_unknown: bool = True,
                  out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, recode(column, dict(mapping), keep_unknown))


def apply_patches(df: DataFrame, key: str, column: str, patches: Mapping | DataFrame) -> DataFrame:
    """Correct single records: ``patches`` maps a key to the new value of ``column``."""
    if isinstance(patches, Mapping):
        return df.withColumn(column, F.coalesce(recode(key, dict(patches)), F.col(column)))
    p = patches.select(key, F.col(column).alias("_patch"))
    return (df.join(p, key, "left").withColumn(column, F.coalesce("_patch", column))
            .drop("_patch"))


def join_site_meta(df: DataFrame, sites: DataFrame, columns: Sequence[str],
                   key: str = "site", how: str = "left") -> DataFrame:
    """Site attributes on every row; Spark broadcasts the site table when its size allows."""
    return df.join(sites.select(key, *columns), key, how)


def sites_with_data(sites: DataFrame, df: DataFrame, key: str = "site") -> DataFrame:
    return sites.join(df.select(key), key, "left_semi")


def sites_without_data(sites: DataFrame, df: DataFrame, key: str = "site") -> DataFrame:
    return sites.join(df.select(key), key, "left_anti")


def fill_from_panel(sites: DataFrame, df: DataFrame, attribute: str, value: str,
                    key: str = "site", date: str = "date") -> DataFrame:
    """Fill a missing site attribute with the value of the site's latest record."""
    last = last_per_site(df, [value], [key], date).withColumnRenamed(value, "_last")
    return (sites.join(last, key, "left")
            .withColumn(attribute, F.coalesce(attribute, "_last")).drop("_last"))


def site_overview(sites: DataFrame, df: DataFrame, key: str = "site",
                  date: str = "date") -> DataFrame:
    """Sites that have data, with the number of months each one has."""
    return sites.join(available_months(df, [key], date), key)


def quality_filter(df: DataFrame, flux: str, value: str, qc: str, klass: str,
                   min_value: float = -1.0, min_qc: float = 0.8,
                   drop_class: str = "WAT") -> DataFrame:
    """Keep measured fluxes, plausible values, mostly original data and land sites.

    A record without a class is kept.
    """
    return df.where(F.col(flux).isNotNull() & (F.col(value) > min_value)
                    & (F.col(qc) > min_qc) & ~F.col(klass).eqNullSafe(F.lit(drop_class)))


def exclude_classes(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Drop listed classes; a missing class is kept."""
    return df.where(F.coalesce(~F.col(column).isin(list(classes)), F.lit(True)))


def drop_ids(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Drop listed records, such as an outlier run; a missing id is kept."""
    return exclude_classes(df, key, ids)


def keep_labels(df: DataFrame, column: str, labels: Sequence) -> DataFrame:
    """Only records with a listed label."""
    return df.where(F.col(column).isin(list(labels)))


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def drop_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def _times(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def qa_report(df: DataFrame, value: str, qc: str, klass: str, key: str = "site",
              date: str = "date", min_value: float = -1.0, min_qc: float = 0.8,
              drop_class: str = "WAT") -> DataFrame:
    """Row, site and rejection counts and the date range, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("site_months"),
        F.countDistinct(key).alias("sites"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        _times(F.col(value) <= min_value).alias("low_value"),
        _times(F.col(qc) <= min_qc).alias("low_qc"),
        F.countDistinct(F.when(F.col(klass) == drop_class, F.col(key))).alias("dropped_sites"))


def align_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides matched on the keys, unmatched rows kept."""
    return left.join(right, list(keys), "full_outer")


def reindex_to(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per wanted key; keys without a row come back with NULLs."""
    return keys_df.select(*keys).join(df, list(keys), "left")


def union_tagged(frames: Mapping, tag: str = "rep") -> DataFrame:
    """Stack frames of one layout, naming where each row came from."""
    out = None
    for name, f in frames.items():
        f = f.withColumn(tag, F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def zscore(df: DataFrame, value: str, by: Sequence[str], out: str = "z") -> DataFrame:
    """(x - mean) / sample standard deviation within each group."""
    from panelgrid.functions.columns import ratio
    from panelgrid.operators.grouping import attach_stats
    j = attach_stats(df, by, _m=F.avg(value), _s=F.stddev_samp(value))
    return j.withColumn(out, ratio(F.col(value) - F.col("_m"), "_s")).drop("_m", "_s")
