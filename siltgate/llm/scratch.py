"""Intermediate tables in the folder that all executors share, and the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..stored import Scratch, shared_dir

__all__ = ["Scratch", "read", "shared_dir"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
