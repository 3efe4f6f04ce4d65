"""Interval arithmetic and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the overlap over the shorter interval's length."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1), F.least(a1 - a0, b1 - b0))


def merge_windows(df: DataFrame, keys: list[str], start: str = "start_at", end: str = "end_at") -> DataFrame:
    """Union of intervals by key; adjacent whole-number intervals are merged too."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) <= before + 1, 0).otherwise(1))
    grouped = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def points_in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Equi-join on keys and buckets of ``width``, then the exact test: a range join without a nested loop."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "_b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_b")
