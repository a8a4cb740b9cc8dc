"""Model table persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xgspark.schemas import MODEL_TABLE_SCHEMA
from xgspark.session import path_exists


class ModelUnavailable(FileNotFoundError):
    """No model table at the given path."""


def save_model(model_table: DataFrame, path: str) -> None:
    """Write the model table (coefficients + feature order) as Parquet,
    replacing any previous one (S7)."""
    model_table.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, on_missing: str = "error") -> DataFrame | None:
    """Read a model table (S8); an empty table is a missing one.

    ``on_missing='error'`` raises :class:`ModelUnavailable` (command-line
    behaviour); ``'mark'`` returns None so scoring marks rows
    ``model_unavailable`` (service behaviour).
    """
    if path_exists(spark, path):
        df = spark.read.schema(MODEL_TABLE_SCHEMA).parquet(path)
        if not df.isEmpty():
            return df
    if on_missing == "mark":
        return None
    raise ModelUnavailable(f"no model at {path}")
