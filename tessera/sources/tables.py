"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """Table ``name`` of ``folder``, a path in any file system that Spark reads; ``options`` are those of Spark's reader."""
    return spark.read.options(**options).parquet(f"{folder}/{name}.parquet")
