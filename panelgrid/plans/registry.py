"""Registry of queries, each with its SQL twin, and the result format both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DECIMALS = 6


def present(df: DataFrame) -> DataFrame:
    """Round doubles, print dates and widen integers, as the SQL twin does."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DECIMALS) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame``; ``sql`` is the DuckDB statement for the same result."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from panelgrid.plans.views import Views
            return present(fn(Views(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def r(expr: str, name: str) -> str:
    """SQL rounding that matches :func:`present`."""
    return f"round(CAST({expr} AS DOUBLE), {DECIMALS}) + 0.0 AS {name}"


def d(expr: str, name: str) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR) AS {name}"


def i(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"
