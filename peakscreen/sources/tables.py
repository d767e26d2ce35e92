"""Table sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from peakscreen import schema as S


def read_reports(spark: SparkSession, path: str, fmt: str | None = None,
                 schema: T.StructType = S.REPORT_SCHEMA) -> DataFrame:
    """Reported-results table from CSV (with header) or Parquet."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a feature / sample-info table as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`write_table`."""
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` including its scaler."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a model saved by :func:`save_model`."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def save_fitted(spark: SparkSession, fitted, path: str) -> None:
    """Persist a ``FittedModel`` whole: pipeline (scaler included), name, features and threshold."""
    from peakscreen.operators.forest import Forest
    forest = isinstance(fitted.model, Forest)
    if forest:
        fitted.model.save(f"{path}/forest")
    else:
        save_model(fitted.model, f"{path}/pipeline")
    about = {"name": fitted.name, "features": list(fitted.features), "threshold": fitted.threshold, "forest": forest}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_fitted(spark: SparkSession, path: str):
    """Load a model saved by :func:`save_fitted`, ready to score."""
    from peakscreen.operators.forest import Forest
    from peakscreen.operators.modeling import FittedModel
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = Forest.load(spark, f"{path}/forest") if about.get("forest") else load_model(f"{path}/pipeline")
    return FittedModel(about["name"], model, about["features"], about["threshold"])
