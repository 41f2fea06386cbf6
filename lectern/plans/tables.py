"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table: a Parquet file or a folder of Parquet files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
