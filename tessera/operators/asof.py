"""As-of join by one sort: no pair of rows is ever built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], within_seconds: int | None = None) -> DataFrame:
    """left with the columns ``take`` of the last right row of the same keys at or before its time.

    Both sides are put in one table, sorted by key and time, and the last right row is carried forward: one shuffle, linear in both
    sides. At equal times right rows come first; among those the greatest of ``take`` wins.
    """
    extra = [c for c in left.columns if c not in keys and c != at]
    value = F.struct(F.col(at).alias("_at"), *take)
    r = right.select(*keys, at, value.alias("_r"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    both = left.select(*keys, at, F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"), *extra).unionByName(r)
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if within_seconds is not None:
        seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
        fresh = seconds(at) - seconds("_last._at") <= within_seconds
        out = out.withColumn("_last", F.when(fresh, F.col("_last")))
    return out.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in take])
