"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data directory: ``{folder}/{name}.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
