"""Session and cache telemetry over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RE_PRIME = 20_000


def runs(df: DataFrame, key: str, value: str, order: list[str], least: int, id_column: str) -> DataFrame:
    """Runs of equal consecutive values of at least ``least`` rows: key, first_id, value, n."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, value, "_run").agg(F.min(id_column).alias("first_id"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def cache_churn(turns: DataFrame, keys: list[str], order: list[str], created: str, read: str) -> DataFrame:
    """turns with ``kind`` (what a turn did to the cached prefix) and ``recreated`` (tokens written a second time)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c, r = F.col(created), F.col(read)
    own = turns.withColumn("_prior", F.lag(c + r).over(w))
    again = (c >= RE_PRIME) & (F.col("_prior") >= RE_PRIME) & (c + r >= F.col("_prior") * 0.8)
    kind = F.when(F.col("_prior").isNull(), "initial_observation").when(c == 0, F.when(r > 0, "cache_hit").otherwise("uncached")).when(r >= F.col("_prior"), "prefix_growth").when(again, "suspected_recreation").otherwise("unclassified_write")
    own = own.withColumn("kind", kind)
    lost = F.when(F.col("kind") == "suspected_recreation", F.least(c, F.greatest(F.lit(0), F.col("_prior") - r))).otherwise(0)
    return own.withColumn("recreated", lost.cast("long")).drop("_prior")


def idle_gaps(events: DataFrame, keys: list[str], order: list[str], minutes: float) -> DataFrame:
    """Rows that follow the one before after at least so many minutes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    return events.withColumn("minutes", (at - F.lag(at).over(w)) / 60e6).where(F.col("minutes") >= minutes)


def cache_ttl(events: DataFrame, key: str, hit: str, miss: str) -> DataFrame:
    """key, lower (longest idle time before a hit), hits, upper (shortest idle time of a miss not below lower), in seconds."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    idle = events.select(key, "event_type", ((at - F.lag(at).over(w)) / 1e6).alias("idle"))
    low = F.max(F.when(F.col("event_type") == hit, F.col("idle"))).over(Window.partitionBy(key))
    hits = F.count_if((F.col("event_type") == hit) & F.col("idle").isNotNull()).over(Window.partitionBy(key))
    own = idle.withColumn("lower", low).withColumn("hits", hits)
    upper = F.min(F.when((F.col("event_type") == miss) & (F.col("idle") >= F.col("lower")), F.col("idle")))
    return own.groupBy(key, "lower", "hits").agg(F.round(upper, 3).alias("upper")).select(key, F.round("lower", 3).alias("lower"), "hits", "upper")


def prefix_elements(messages: Column) -> Column:
    """Digests of the elements of a request's stable prefix: its messages (structs of role and text) without a last one of the user."""
    last_is_user = F.element_at(messages, -1)["role"] == "user"
    stable = F.when((F.size(messages) > 0) & last_is_user, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)
    return F.transform(stable, lambda m: F.concat(F.lit("message:"), F.sha2(F.concat_ws("\n", m["role"], F.coalesce(m["text"], F.lit(""))), 256)))


def prefix_reuse(requests: DataFrame, key: str, order: str, elements: str = "elements") -> DataFrame:
    """requests with ``reuse``: exact where a request's elements are those of the request before it (of the same key), extended where
    they begin with those (at least one), else miss; also ``reused``, the number of elements shared from the start."""
    w = Window.partitionBy(key).orderBy(order)
    before, now = F.lag(elements).over(w), F.col(elements)
    own = requests.withColumn("_before", before)
    b = F.col("_before")
    same = F.when(b.isNull(), "miss").when(b == now, "exact").when((F.size(b) > 0) & (F.slice(now, F.lit(1), F.size(b)) == b), "extended").otherwise("miss")
    apart = F.array_position(F.transform(F.arrays_zip(b.alias("x"), now.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])), True)
    shared = F.when(b.isNull(), 0).when(apart == 0, F.size(now)).otherwise(apart - 1)
    return own.withColumn("reuse", same).withColumn("reused", shared.cast("long")).drop("_before")


def waste_signals(calls: DataFrame, session: str, turn: str, order: list[str], command: str, output: str, failed: str, edit: str) -> DataFrame:
    """session, turn, signal, about and the order columns of its first call: each signal is told once in a turn.

    repeat: three of the session's last ten calls have this command and turn. retry: three of its last six failures have this
    command, output and turn. cascade: twelve calls of the turn without an edit. ``failed`` and ``edit`` are boolean columns.
    Windows hold ten and six rows; a session is one conversation.
    """
    w = Window.partitionBy(session).orderBy(*order)
    same = lambda frame, *names: F.size(F.filter(F.collect_list(F.struct(*names)).over(frame), lambda x: x == F.struct(*names)))
    tag = lambda df, signal, about, where: df.where(where).select(session, turn, F.lit(signal).alias("signal"), about.cast("string").alias("about"), *order)
    one = calls.select(session, turn, *order, command, F.coalesce(output, F.lit("")).alias("_out"), F.coalesce(failed, F.lit(False)).alias("_bad"), F.coalesce(edit, F.lit(False)).cast("int").alias("_edit"))
    spent = Window.partitionBy(session, turn).orderBy(*order)
    seen = one.withColumn("_n", same(w.rowsBetween(-9, 0), turn, command)).withColumn("_calls", F.row_number().over(spent)).withColumn("_edits", F.sum("_edit").over(spent))
    failures = one.where("_bad").withColumn("_n", same(w.rowsBetween(-5, 0), turn, command, "_out"))
    told = tag(seen, "repeat", F.col(command), F.col("_n") >= 3)
    told = told.unionByName(tag(failures, "retry", F.concat_ws(":", command, F.md5(F.col("_out").cast("binary"))), (F.col("_n") >= 3) & (F.col("_out") != "")))
    told = told.unionByName(tag(seen, "cascade", F.lit(""), (F.col("_calls") >= 12) & (F.col("_edits") == 0)))
    first = told.groupBy(session, turn, "signal", "about").agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(session, turn, "signal", "about", "_f.*")


def diagnostics_delta(snapshots: DataFrame, keys: list[str], order: list[str], found: str) -> DataFrame:
    """snapshots with ``added``, ``resolved`` and ``remaining`` against the snapshot before of the same keys; null for the first,
    and where the one before had nothing. ``found`` is an array; a null one is empty."""
    own = snapshots.withColumn(found, F.coalesce(F.col(found), F.array().cast(snapshots.schema[found].dataType)))
    before = F.lag(found).over(Window.partitionBy(*keys).orderBy(*order))
    out = own.withColumn("_before", F.when(F.size(before) > 0, before))
    sets = {"added": F.array_except(found, "_before"), "resolved": F.array_except("_before", found), "remaining": F.array_intersect(found, "_before")}
    return out.withColumns({name: F.array_sort(value) for name, value in sets.items()}).drop("_before")
