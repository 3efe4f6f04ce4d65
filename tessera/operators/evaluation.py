"""Retrieval evaluation and field learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(expected: Column, found: Column) -> Column:
    """Share of the expected set that was found; 1 where nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, found)) / F.size(expected))


def field_hints(exposures: DataFrame, tool: str, field: str, hit: str, top: int = 16) -> DataFrame:
    """tool, field, confidence: fields exposed 3 times and retrieved twice or more, with confidence of at least 0.3; the best 16 a tool."""
    f = exposures.groupBy(tool, field).agg(F.count("*").alias("e"), F.count_if(F.col(hit)).alias("r")).where("e >= 3 and r >= 2")
    f = f.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("r") / F.col("e")), 6)).where("confidence >= 0.3")
    w = Window.partitionBy(tool).orderBy(F.desc("confidence"), F.desc("r"), field)
    return f.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).select(tool, field, "confidence")


def table_fingerprint(df: DataFrame, row: Column) -> DataFrame:
    """rows, low, high: a digest of all rows whatever their order, from sums of two parts of each row's digest.

    Sums are partial aggregates, so nothing is sorted and no task holds more than a row.
    """
    part = lambda at: F.conv(F.substring("m", at, 11), 16, 10).cast("decimal(38,0)")
    own = df.select(F.md5(row.cast("binary")).alias("m")).where("m is not null")
    return own.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part(1)), F.lit(0)).cast("string").alias("low"), F.coalesce(F.sum(part(12)), F.lit(0)).cast("string").alias("high"))
