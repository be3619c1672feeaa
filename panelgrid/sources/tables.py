"""Panel, site and metric tables as CSV or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panelgrid.functions.columns import sanitize


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """CSV with a header under an explicit schema; empty fields are NULL, NaN and inf too.

    Columns are matched by position to the schema, and the header must agree with it.
    """
    df = spark.read.schema(schema).options(header=True, enforceSchema=False, nanValue="nan",
                                           dateFormat="yyyy-MM-dd").csv(path)
    return sanitize(df)


def read_tagged(spark: SparkSession, root: str, tags: DataFrame, schema: StructType,
                key: str = "exp_id") -> DataFrame:
    """One metric table per experiment below ``root`` (``exp_id=...`` folders), tag columns joined.

    All experiments are read in one scan; those without a tag row are left out.
    """
    rest = StructType([f for f in schema.fields if f.name != key])
    keyed = StructType(rest.fields + [schema[key]])
    # the key is a folder name and is read as text, as in the schema
    df = spark.read.schema(keyed).parquet(root)
    return df.join(tags, key)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` writes through one task: ask for it on small results."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str],
                      sort: Sequence[str] = ()) -> None:
    """Parquet by partition; only the partitions present in ``df`` are replaced.

    Rows are clustered by partition first, so a partition is not scattered over small files. The
    rebalance hint lets adaptive execution split a partition that holds most of the rows.
    """
    out = df.hint("rebalance", *keys)
    if sort:
        out = out.sortWithinPartitions(*keys, *sort)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def write_metrics(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["exp_id"])
