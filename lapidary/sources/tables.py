"""Table access: one Parquet file or folder per table under a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def delivered_once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows without repeated deliveries.

    A row delivered twice is equal in every column, so any of the equal rows stands for all. The rows are
    grouped by ``keys`` (map-side first), not by all columns: maps can't be grouped.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in rest]).select(*df.columns)
