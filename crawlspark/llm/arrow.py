"""Sizes of the Arrow batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds what a Python worker holds of long texts at one time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
