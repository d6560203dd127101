"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.session import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` as stored; scans prune columns and push filters down by themselves."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
