"""Keyed state with the same meaning for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.streaming.windows import late


def first_of_each(events: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """keys and the id of the first event of each; a stream keeps a key's state within the watermark only."""
    if events.isStreaming:
        return late(events).dropDuplicatesWithinWatermark(keys).select(*keys, F.col(id_column).alias("first_id"))
    return events.groupBy(*keys).agg(F.min(id_column).alias("first_id"))


def keep_newest(path: str, n: int, order: str):
    """A foreachBatch function that appends a micro-batch to a table and keeps its newest n rows as a view of it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(path)

    def read(spark) -> DataFrame:
        return spark.read.parquet(path).orderBy(F.desc(order)).limit(n)

    return write, read


def bounded_counter(events: DataFrame, key: str, delta: str, order: list[str], bound: int = 10, bucket: Column | None = None) -> DataFrame:
    """key and a counter that follows its deltas in order and is clamped to -bound..bound at every step.

    A run of clamped steps maps x to min(high, max(low, x + total)), and such maps compose; so a key's events are first folded in
    each ``bucket`` (a column that grows with the order, such as the day), then the buckets in their order: a hot key is split.
    """
    low, high = F.lit(-bound), F.lit(bound)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-(1 << 40)).cast("long").alias("low"), F.lit(1 << 40).cast("long").alias("high"))

    def then(a: Column, total: Column, lo: Column, hi: Column) -> Column:
        """The map a, then the map of total, lo, hi."""
        put = lambda x: F.least(hi, F.greatest(lo, x + total)).cast("long")
        return F.struct((a["total"] + total).cast("long").alias("total"), put(a["low"]).alias("low"), put(a["high"]).alias("high"))

    own = events.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    steps = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(delta), F.lit(0)).cast("long").alias("_d"))))
    maps = own.groupBy(key, "_bucket").agg(F.aggregate(steps, start, lambda a, x: then(a, x["_d"], low, high)).alias("_m"))
    parts = F.array_sort(F.collect_list(F.struct("_bucket", "_m")))
    folded = maps.groupBy(key).agg(F.aggregate(parts, F.lit(0).cast("long"), lambda x, p: F.least(p["_m"]["high"], F.greatest(p["_m"]["low"], x + p["_m"]["total"]))).alias("value"))
    return folded.select(key, "value")
