"""Queries of the keyed store: what it holds after batches, replays and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.sources.store import KeyedStore
from tessera.sources.tables import new_path

BATCHES = 3


def _batches(df, by: str):
    """The table in batches by a column, the second one given twice as after a failure."""
    for i in (0, 1, 1, 2):
        yield i, df.where(F.pmod(F.col(by), F.lit(BATCHES)) == i)


@query("s10_store_put", "SELECT handle, arg_min(event_id, (event_id % 3, event_id)) AS event_id, arg_min(size, (event_id % 3, event_id)) AS size FROM (SELECT event_id, 'h' || substr(sha256(props), 1, 24) AS handle, CAST(octet_length(encode(props)) AS BIGINT) AS size FROM events WHERE props IS NOT NULL) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").where("props is not null").select(F.concat(F.lit("h"), F.substring(F.sha2("props", 256), 1, 24)).alias("handle"), "event_id", F.octet_length("props").cast("long").alias("size"))
    store = KeyedStore(spark, new_path(spark, "recovery"), "handle string, event_id long, size long", "handle")
    for i, batch in _batches(e, "event_id"):
        store.put(batch, ["event_id"], "events", i, size="size", capacity=1 << 40)
    return store.read()


@query("s12_store_upsert", "SELECT user_id || '/' || event_type AS field, count(*) AS exposures, max(ts) AS last_seen FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    own = e.select(F.concat_ws("/", "user_id", "event_type").alias("field"), F.lit(1).cast("long").alias("exposures"), F.col("ts").alias("last_seen"), "event_id")
    store = KeyedStore(spark, new_path(spark, "fields"), f"field string, exposures long, last_seen {dict(own.dtypes)['last_seen']}", "field")
    for i, batch in _batches(own, "event_id"):
        store.upsert(batch, {"exposures": F.sum("exposures"), "last_seen": F.max("last_seen")}, "events", i)
    return store.read()


# a store of all events, compacted to half of what they take
@query("st9_store_compaction", "SELECT event_id, size FROM (SELECT *, sum(size) OVER (ORDER BY ts DESC, event_id DESC) AS upto, sum(size) OVER () AS total FROM (SELECT event_id, ts, CAST(octet_length(encode(props)) AS BIGINT) AS size FROM events)) WHERE upto <= total // 2")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.octet_length("props").cast("long").alias("size"))
    store = KeyedStore(spark, new_path(spark, "log"), f"event_id long, ts {dict(e.dtypes)['ts']}, size long", "event_id")
    for i, batch in _batches(e, "event_id"):
        store.put(batch, ["event_id"], "events", i)
    total = store.read().agg(F.sum("size")).first()[0] or 0
    store.compact(total // 2, "size", "ts", F.to_date("ts"))
    return store.read().select("event_id", "size")
