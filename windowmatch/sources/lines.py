"""Text files as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, in column ``value``."""
    return spark.read.text(path).select("value")


def write_lines(text: DataFrame, path: str) -> None:
    """Write a one-column frame as text files, one row after another."""
    text.write.text(path)
