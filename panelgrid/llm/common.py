"""Helpers that the text operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from panelgrid.session import pin

LEAF = 1000  # rows a window sorts at a time, on average


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a document by its id and text; rows that repeat both share one key."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"),
                    F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("\0null")), 256), 1, 24))


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, so that further columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def prefix_sums(df: DataFrame, group: list[str], key: str, weight: str, out: str,
                n: int) -> DataFrame:
    """``out``: the sum of ``weight`` over the rows of ``group`` that come before in order of ``key``.

    ``key`` is a hex digest, unique in its group. Rows are summed per leading digits first; as many
    digits as leave about ``LEAF`` of the ``n`` rows together, so no window holds a whole group.
    ``df`` is read twice: pin it first.
    """
    digits = 2 * max(1, math.ceil(math.log(max(n, 1) / LEAF, 256))) if n > LEAF else 2
    return _prefix_sums(df, group, key, weight, out, digits)


def _prefix_sums(df, group, key, weight, out, digits):
    block, start = f"_block{digits}", f"_start{digits}"
    cut = df.withColumn(block, F.substring(key, 1, digits))
    totals = cut.groupBy(*group, block).agg(F.sum(weight).alias("_total"))
    if digits > 2:
        starts = _prefix_sums(totals, group, block, "_total", start, digits - 2)
    else:
        before = Window.partitionBy(*group).orderBy(block).rowsBetween(
            Window.unboundedPreceding, -1)
        starts = totals.withColumn(start, F.coalesce(F.sum("_total").over(before), F.lit(0)))
    own = Window.partitionBy(*group, block).orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1)
    inner = cut.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return (inner.join(starts.select(*group, block, start), [*group, block])
            .withColumn(out, F.col("_own") + F.col(start)).drop("_own", start, block))


def compute(df: DataFrame, column: str, fields: str, make: Callable) -> DataFrame:
    """Replaces ``column`` by columns computed from it; all others pass through as they are.

    ``make()`` runs once per task and gives the function from a value to a tuple of the ``fields``.
    """
    added = T._parse_datatype_string(fields)
    kept = [f for f in df.schema.fields if f.name != column]
    types = list(to_arrow_schema(added).types)
    names = [f.name for f in kept] + added.fieldNames()

    def run(batches):
        f = make()
        for b in batches:
            found = [f(x) for x in b.column(column).to_pylist()]
            arrays = [b.column(x.name) for x in kept]
            arrays += [pa.array([x[i] for x in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, T.StructType(kept + added.fields))


__all__ = ["compute", "documents", "narrow", "pin", "prefix_sums", "row_key"]
