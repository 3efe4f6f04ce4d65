"""Differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, state: NEW, RESOLVED, UNCHANGED or CHANGED."""
    a = before.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_a").isNull(), "NEW").when(F.col("_in_b").isNull(), "RESOLVED").when(F.col("_a").eqNullSafe(F.col("_b")), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))
