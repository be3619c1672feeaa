"""Gridded ensembles and covariates as partitioned Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.functions.constants import REANALYSIS_RENAMES
from panelgrid.operators.grid import rounded

# Latitude bands of this many degrees cluster a written cube.
LAT_BAND = 10.0


def write_ensemble(df: DataFrame, path: str, pred_id: str = "pred_id",
                   time: str = "time") -> None:
    """Cube partitioned by prediction and year.

    Rows are spread by prediction, year and latitude band and sorted by cell, so files are of
    even size and cell filters skip row groups.
    """
    out = df.withColumn("year", F.year(time)).withColumn("_band", F.floor(F.col("lat") / LAT_BAND))
    (out.hint("rebalance", pred_id, "year", "_band").sortWithinPartitions(pred_id, "year", "lat", "lon")
     .drop("_band").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(pred_id, "year").parquet(path))


def ensemble_scan(spark: SparkSession, path: str, pred_ids: Sequence[str] | None = None,
                  start: date | None = None, end: date | None = None,
                  variables: Sequence[str] = ("v",), ignore_missing: bool = True) -> DataFrame:
    """Chosen predictions and dates (both ends included) of a partitioned cube.

    The year filter prunes folders, the date filter is pushed into the files, and unread
    variables are never decoded. Predictions or years without files give no rows; files that
    vanish during the read are skipped when ``ignore_missing``.
    """
    schema = T.StructType(
        [T.StructField(c, t) for c, t in (("lat", T.DoubleType()), ("lon", T.DoubleType()),
                                          ("time", T.DateType()), ("rep", T.IntegerType()))]
        + [T.StructField(v, T.DoubleType()) for v in variables]
        + [T.StructField("pred_id", T.StringType()), T.StructField("year", T.IntegerType())])
    df = spark.read.schema(schema).option("ignoreMissingFiles", ignore_missing).parquet(path)
    if pred_ids is not None:
        df = df.where(F.col("pred_id").isin(list(pred_ids)))
    if start is not None:
        df = df.where((F.col("year") >= start.year) & (F.col("time") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("year") <= end.year) & (F.col("time") <= F.lit(end)))
    return df.select("lat", "lon", "time", "rep", "pred_id", *variables)


def repetition_ids(pred_id: str, n: int = 30) -> list[str]:
    """Names of the repetitions of a prediction."""
    return [f"{pred_id}_{k}" for k in range(n)]


def write_covariates(df: DataFrame, path: str) -> None:
    """Long covariates (dataset, var, lat, lon, time, value) by dataset, variable and year."""
    out = (df.withColumn("year", F.year("time"))
           .withColumn("_band", F.floor(F.col("lat") / LAT_BAND)))
    (out.hint("rebalance", "dataset", "var", "year", "_band").drop("_band")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset", "var", "year").parquet(path))


def load_covariates(spark: SparkSession, path: str, wanted: Mapping[str, Sequence[str]],
                    year: int, month: int | None = None, static: Sequence[str] = ("MCD12Q1",),
                    renames: Mapping[str, str] = REANALYSIS_RENAMES) -> DataFrame:
    """Wanted variables of a year (or month) side by side on rounded coordinates.

    Only folders of wanted variables are read, and one shuffle lines all of them up. A yearly
    layer (land cover) is stamped with every month asked for.
    """
    pairs = [(d, v) for d, vs in wanted.items() for v in vs]
    cond = F.lit(False)
    for d, v in pairs:
        cond = cond | ((F.col("dataset") == d) & (F.col("var") == v))
    df = spark.read.parquet(path).where(F.col("year") == year).where(cond)
    months = [month] if month else list(range(1, 13))
    yearly = F.col("dataset").isin(list(static))
    if month:
        df = df.where(yearly | (F.month("time") == month))
    ends = F.array(*[F.last_day(F.make_date(F.lit(year), F.lit(m), F.lit(1))) for m in months])
    df = df.withColumn("time", F.explode(F.when(yearly, ends).otherwise(
        F.array(F.last_day("time")))))
    df = rounded(df)
    return df.groupBy("lat", "lon", "time").agg(*[
        F.max(F.when((F.col("dataset") == d) & (F.col("var") == v), F.col("value")))
        .alias(renames.get(v, v)) for d, v in pairs])


def mask_scan(spark: SparkSession, path: str, value: str, renames: Mapping[str, str] = {},
              drop: Sequence[str] = ("time",), schema: T.StructType | None = None) -> DataFrame:
    """A mask table as (lat, lon, m)."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path).withColumnsRenamed(dict(renames)).drop(*drop)
    return df.select("lat", "lon", F.col(value).cast("double").alias("m"))


def random_grid(spark: SparkSession, n_lat: int = 100, n_lon: int = 100, reps: int = 2,
                day: date = date(2005, 5, 31), seed: int = 0, top: float = 12.0) -> DataFrame:
    """A made-up grid of one month for tests and demos."""
    from panelgrid.functions.columns import uniform
    cells = spark.range(n_lat * n_lon * reps)
    c = F.col("id")
    lat = F.floor(c / (n_lon * reps)) * (180.0 / n_lat) - 90
    lon = F.floor(F.pmod(c, F.lit(n_lon * reps)) / reps) * (360.0 / n_lon) - 180
    return cells.select(F.round(lat, 3).alias("lat"), F.round(lon, 3).alias("lon"),
                        F.lit(day).alias("time"),
                        (F.pmod(c, F.lit(reps)) + 1).cast("int").alias("rep"),
                        (uniform(seed, "id") * top).alias("v"))
