"""Experiments as tables: runs, folds and predictions, instead of a folder per repetition."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.config import ExperimentConfig
from panelgrid.sources.schemas import FOLDS, PREDICTIONS, RUNS
from panelgrid.sources.tables import write_partitioned


def experiment_id(job: str = "", suffix: str | None = None, prepend_date: bool = True,
                  now: dt.datetime | None = None) -> str:
    """``YYYYMMDD`` + job id + ``_`` + suffix; without a job id the time of day is used."""
    now = now or dt.datetime.now()
    if job == "":
        job, prepend_date = now.strftime("%H%M%S"), True
    return (now.strftime("%Y%m%d") if prepend_date else "") + job + (f"_{suffix}" if suffix else "")


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def save_experiment(root: str, predictions: DataFrame, folds: DataFrame | None = None,
                    features: DataFrame | None = None) -> None:
    """Write predictions (and folds, and the feature table) below ``root``, keyed by exp_id.

    Saving an experiment again replaces its partitions and leaves the others alone.
    """
    write_partitioned(_conform(predictions, PREDICTIONS), os.path.join(root, "predictions"),
                      ["exp_id", "rep"])
    if folds is not None:
        write_partitioned(_conform(folds, FOLDS), os.path.join(root, "folds"), ["exp_id", "rep"])
    if features is not None:
        write_partitioned(features, os.path.join(root, "features"), ["exp_id"])


def register_run(spark: SparkSession, root: str, exp_id: str, rep: int, started: dt.datetime,
                 seconds: float, config: ExperimentConfig) -> None:
    """Append one row to the run registry."""
    row = [(exp_id, rep, started, float(seconds), config.to_json())]
    spark.createDataFrame(row, RUNS).write.mode("append").parquet(os.path.join(root, "runs"))


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(os.path.join(root, "runs"))


def load_config(spark: SparkSession, root: str, exp_id: str) -> ExperimentConfig:
    row = load_runs(spark, root).where(F.col("exp_id") == exp_id).orderBy(F.desc("started")).first()
    if row is None:
        raise KeyError(exp_id)
    return ExperimentConfig(**json.loads(row["params"]))


def _load(spark, root, table, schema, prefix):
    df = spark.read.schema(schema).parquet(os.path.join(root, table))
    if prefix is not None:
        # a filter on the partition column: other experiments' folders are not listed further
        df = df.where(F.col("exp_id").startswith(prefix))
    return df


def load_predictions(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    """Predictions of every repetition whose experiment id starts with ``prefix``."""
    return _load(spark, root, "predictions", PREDICTIONS, prefix)


def load_folds(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    return _load(spark, root, "folds", FOLDS, prefix)


def load_features(spark: SparkSession, root: str, exp_id: str) -> DataFrame:
    """The feature table saved with an experiment."""
    return spark.read.parquet(os.path.join(root, "features")).where(F.col("exp_id") == exp_id)
