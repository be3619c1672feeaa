"""Cubes stored for maps: bucketed by cell, and as mergeable moments that grow by repetitions."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.operators import moments
from panelgrid.operators.maps import CELL


#: Key of a stored cell: its coordinates in thousandths of a degree. Spark rewrites floating-point keys
#: in joins, and would shuffle tables that are bucketed by them.
STORED_CELL = ("ilat", "ilon")


def store_by_cell(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write a cube as a catalog table whose files hold whole cells, and read it back.

    Cells, with lat and lon as integer keys (STORED_CELL) instead, are hashed into ``buckets``, each one
    sorted file. Whatever groups or joins such tables by cell, or groups them by cell and time, reads
    them as they lie: nothing is shuffled. One task writes and later reads a bucket, so give as many as
    the cube has parts of 100 to 200 MB; tables to be joined need equally many.
    """
    keyed = df.select(*[F.rint(F.col(c) * 1000).cast("int").alias(k) for c, k in zip(CELL, STORED_CELL)],
                      *[c for c in df.columns if c not in CELL])
    (keyed.repartition(buckets, *STORED_CELL).write.mode("overwrite").format("parquet")
     .option("path", path).bucketBy(buckets, *STORED_CELL).sortBy(*STORED_CELL).saveAsTable(table))
    return df.sparkSession.table(table)


def in_degrees(df: DataFrame) -> DataFrame:
    """The keys of stored cells as lat and lon again."""
    return df.select(*[(F.col(k) / 1000).alias(c) for c, k in zip(CELL, STORED_CELL)],
                     *[c for c in df.columns if c not in STORED_CELL])


def merge_stored(tables: Mapping[str, DataFrame], value: str = "v") -> DataFrame:
    """Many stored one-variable cubes side by side, cells and times of any of them kept.

    The tables are joined by cell, as their buckets are, each cell bringing its series as one map from
    time to value, as long as the period. Several values of a cell and time are averaged on the way.
    """
    cell = list(STORED_CELL)

    def series(name):
        mean = tables[name].groupBy(*cell, "time").agg(F.avg(value).alias("_v"))
        return mean.groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("time", "_v"))).alias(name))

    both = reduce(lambda a, b: a.join(b, cell, "full_outer"), [series(n) for n in tables])
    times = F.array_distinct(F.flatten(F.array(*[
        F.coalesce(F.map_keys(n), F.array().cast("array<date>")) for n in tables])))
    long = both.withColumn("time", F.explode(times))
    return in_degrees(long.select(*cell, "time", *[F.try_element_at(n, F.col("time")).alias(n) for n in tables]))


# ---- moments that grow -------------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(os.path.join(path, "merged"))
    except AnalysisException:  # nothing has been written yet
        return None


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    """The moments after the last repetition that was merged."""
    version = _versions(spark, path).agg(F.max("version")).first()[0]
    return spark.read.parquet(os.path.join(path, f"moments-{version}"))


def merge_repetitions(ensemble: DataFrame, path: str, value: str = "v",
                      cell: Sequence[str] = CELL) -> DataFrame:
    """Add the repetitions in ``ensemble`` to the stored moments; only the new rows are scanned.

    The new state is written beside the old one and only then listed in ``merged``, so a run that dies
    half way leaves the old state. A repetition that is listed already raises ValueError.
    """
    spark = ensemble.sparkSession
    new = [r["rep"] for r in ensemble.select("rep").distinct().collect()]
    known, version = _versions(spark, path), 1
    state = moments.ensemble_moments(ensemble, value, cell)
    if known is not None:
        again = [r["rep"] for r in known.where(F.col("rep").isin(new)).collect()]
        if again:
            raise ValueError(f"repetitions {sorted(again)} are merged already")
        version = known.agg(F.max("version")).first()[0] + 1
        state = moments.merge(read_moments(spark, path), state, [*cell, "time"])
    state.write.mode("overwrite").parquet(os.path.join(path, f"moments-{version}"))
    spark.createDataFrame([(r, version) for r in new], "rep int, version int").coalesce(1).write.mode(
        "append").parquet(os.path.join(path, "merged"))
    return read_moments(spark, path)
