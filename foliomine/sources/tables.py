"""Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table. The session's split size decides into how many tasks it is
    read; a file of one row group is one of them."""
    return spark.read.parquet(path)
