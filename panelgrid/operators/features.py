"""Feature sets, one-hot columns and their reverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.columns import ratio
from panelgrid.functions.constants import FEATURE_ALIASES, VARIABLE_SETS

# A categorical with more values than this is not a class column.
MAX_CLASSES = 1000


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def classes_of(df: DataFrame, column: str) -> list:
    """Sorted known values of a class column. They become column names, so they are collected;
    a column that is no class column (see MAX_CLASSES) raises."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct()
             .limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{column} has more than {MAX_CLASSES} values")
    return sorted(found)


def one_hot(df: DataFrame, column: str, classes: Sequence | None = None) -> DataFrame:
    """Replace a class column by 0/1 columns ``<column>_<value>``.

    Without ``classes`` the values present are used. With ``classes`` (those stored with a model)
    no pass over the data is needed, missing classes give 0 and others are dropped. A NULL class
    is 0 everywhere and gets no column.
    """
    classes = classes_of(df, column) if classes is None else classes
    flags = [F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0))
             .alias(f"{column}_{v}") for v in classes]
    return df.select(*[c for c in df.columns if c != column], *flags)


def reverse_one_hot(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Name of the largest column, the first one on ties."""
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[F.col(c) for c in columns])
    at = F.array_position(values, F.array_max(values))
    return df.withColumn(out, F.when(at > 0, F.get(names, at.cast("int") - 1)))


def feature_set(df: DataFrame, variables: str | Sequence[str], keys: Sequence[str] = ("site", "date"),
                target: Sequence[str] = (), encode: Sequence[str] = (), date: str = "date",
                rm_all_nulls: bool = True, classes: dict | None = None) -> DataFrame:
    """Select a named (or listed) variable set, add ``year``, encode classes, drop empty rows.

    The target stays in the same row, so nothing has to be aligned afterwards. ``encode`` names
    the class columns to one-hot encode if the set has them.
    """
    if isinstance(variables, str):
        if variables not in VARIABLE_SETS:
            raise ValueError(f"unknown variable set {variables!r}")
        variables = VARIABLE_SETS[variables]
    cols: list[Column] = [F.year(date).alias("year") if c == "year" else F.col(f"`{c}`")
                          for c in variables]
    # a target that is also a feature appears once, under its target name
    kept = [F.col(f"`{t}`").alias(f"target_{t}") if t in variables else F.col(f"`{t}`")
            for t in target]
    out = df.select(*keys, *cols, *kept)
    if rm_all_nulls:
        # encoded classes are never NULL, so a row with an encoded class is not empty
        if not any(c in encode for c in variables):
            out = out.dropna(how="all", subset=[c for c in variables])
    for c in encode:
        if c in variables:
            out = one_hot(out, c, (classes or {}).get(c))
    return out


def store_names(features: Sequence[str]) -> list[str]:
    """Covariate-store names of model features; one-hot columns collapse to their class layer."""
    out: list[str] = []
    for f in features:
        name = (FEATURE_ALIASES["MODIS_LC"] if f.startswith("MODIS_LC")
                else FEATURE_ALIASES.get(f, f))
        if name not in out:
            out.append(name)
    return out


def needed_datasets(features: Sequence[str], datasets: dict[str, list[str]]) -> dict[str, list[str]]:
    """Which variables to read from which dataset."""
    names = set(store_names(features))
    return {d: [v for v in vs if v in names] for d, vs in datasets.items()}


def row_sum(columns: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the known values of a row."""
    known = F.lit(0)
    for c in columns:
        known = known + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return ratio(row_sum(columns), known)


def row_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column divided by the row sum."""
    total = row_sum(columns)
    return df.select(*[ratio(c, total).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def ensemble_mean(df: DataFrame, keys: Sequence[str] = ("site", "date"), pred: str = "pred",
                  carry: Sequence[str] = ()) -> DataFrame:
    """Mean prediction over repetitions, in long form; ``carry`` columns are equal in all."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], F.avg(pred).alias(pred))
