"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key, so that the rows of a hot key are split.

    Adaptive execution splits a skewed partition only where both sides are plain shuffles. A side that was aggregated by
    the keys would be used as it is; a second key that says nothing makes it be shuffled anew, at one row for each key.
    Null keys match nothing.
    """
    side = F.pmod(F.xxhash64(*keys), F.lit(1))
    return rows.withColumn("_side", side).join(keyed.withColumn("_side", side), [*keys, "_side"], how).drop("_side")
