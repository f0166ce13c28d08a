"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table `name` of `data_dir`; any path that Spark's readers accept."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
