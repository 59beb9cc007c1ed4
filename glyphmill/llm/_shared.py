"""Helpers of the operators: reading tables, texts as bytes, scratch tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch, ship

__all__ = ["as_bytes", "drop_scratch", "read", "release", "scratch"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str = "text"):
    return F.col(column).cast("binary")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
