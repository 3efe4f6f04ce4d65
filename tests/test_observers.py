"""Observers: a stream in any micro-batch split gives the rows of the batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans import observer_queries as plans
from tessera.streaming import observers

FOLDS = {"waste": (observers.Waste(), plans.calls), "prefix": (observers.PrefixReuse(), plans.requests), "diagnostics": (observers.Diagnostics(), plans.snapshots), "turns": (observers.Turns(), plans.turns)}


def streamed(spark, events, schema, splits, tmp_path, name, fold, event, ttl=None):
    """The rows of a stream over files in this order, one file a micro-batch, up to the watermark."""
    source, at = tmp_path / "in", datetime.datetime(2024, 1, 1)
    for i, part in enumerate(splits):
        events.where(F.col("event_id").isin(part)).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (source).mkdir(exist_ok=True)
        own = next((tmp_path / f"w{i}").glob("*.parquet"))
        own.rename(source / f"{i:03}.parquet")
        import os

        os.utime(source / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = observers.observe(stream, fold, "user_id", "ts", "event_id", event, ttl, delay="400 days")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", observers.ROCKS_DB)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    q.stop()
    return spark.table(name)


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_is_the_batch(spark, sf, tmp_path, name):
    fold, event = FOLDS[name][0], FOLDS[name][1]()
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 8")
    far = events.limit(1).withColumn("event_id", F.lit(10_000_000).cast("long")).withColumn("user_id", F.lit(-1).cast("long")).withColumn("ts", F.lit("2099-01-01").cast(events.schema["ts"].dataType))
    both = events.unionByName(far).unionByName(far.withColumn("event_id", F.lit(10_000_001).cast("long")))
    ids = [r[0] for r in events.select("event_id").collect()]
    random.Random(name).shuffle(ids)  # rows come in any order, all within the watermark
    cuts = sorted(random.Random(1).sample(range(1, len(ids)), 2))
    splits = [ids[: cuts[0]], ids[cuts[0] : cuts[1]], ids[cuts[1] :], [10_000_000], [10_000_001]]
    got = streamed(spark, both, events.schema, splits, tmp_path, f"seen_{name}", fold, event).where("user_id >= 0")
    want = plans.observed(events, fold, event)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want) and want.count() > 0


def test_idle_keys_start_anew_and_odd_rows(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, 1, day(1), ["a"]), (2, 1, day(2), ["a"]), (3, 1, day(9), ["a"]), (4, None, day(1), None), (5, None, day(1), []), (5, None, day(1), []), (6, 2, None, ["a"])]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, p array<string>")
    see = lambda ttl: sorted((r["event_id"], r["reuse"]) for r in observers.observe(events, observers.PrefixReuse(), "user_id", "ts", "event_id", {"id": F.col("event_id"), "elements": F.col("p")}, ttl).collect())
    assert see(None) == [(1, "miss"), (2, "exact"), (3, "exact"), (4, "miss"), (5, "exact"), (5, "exact")]
    assert see(3 * 86_400) == [(1, "miss"), (2, "exact"), (3, "miss"), (4, "miss"), (5, "exact"), (5, "exact")]
    assert observers.observe(events.where("false"), observers.Waste(), "user_id", "ts", "event_id", {"id": F.col("event_id")}).count() == 0
