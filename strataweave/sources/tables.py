"""Reading the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder (a file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
