"""Streams give what batches give."""

from pyspark.sql import functions as F

from tessera.streaming.state import first_of_each
from tessera.streaming.windows import running_max, tumbling


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    return batch, spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def test_tumbling(spark, sf):
    batch, live = stream(spark, sf)
    cast = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(tumbling(cast(live), "1 hour"), "tumbling", "complete")
    key = lambda df: sorted((str(r["start_at"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(tumbling(cast(batch), "1 hour"))


def test_running_max(spark, sf):
    batch, live = stream(spark, sf)
    key = lambda df: sorted((r["user_id"], r["value"]) for r in df.collect())
    assert key(drained(running_max(live, "user_id", ["value"]), "greatest", "complete")) == key(running_max(batch, "user_id", ["value"]))


def test_dedup(spark, sf):
    batch, live = stream(spark, sf)
    cast = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(first_of_each(cast(live), ["user_id", "event_type", "props"], "event_id"), "firsts", "append")
    assert got.count() == first_of_each(batch, ["user_id", "event_type", "props"], "event_id").count()
