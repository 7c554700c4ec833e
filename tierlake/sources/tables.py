"""Parquet table access with column pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of the dataset folder ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")
