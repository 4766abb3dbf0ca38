"""The engine's tables, as Parquet files of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; only the columns and rows that the plan needs are read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
