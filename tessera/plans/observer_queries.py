"""Queries of the observers with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import ORACLE, query, table
from tessera.plans import relational_queries, stage_queries  # noqa: F401  their SQL serves here too
from tessera.streaming import observers


def calls():
    """Events as tool calls: the type is the command, errors are failures, purchases are edits, a year is a turn."""
    output = F.md5((_k() % 2).cast("string").cast("binary"))
    return {"id": F.col("event_id"), "turn": F.year("ts"), "command": F.col("event_type"), "output": output, "output_hash": F.md5(output.cast("binary")), "failed": F.col("event_type") == "error", "edit": F.col("event_type") == "purchase"}


def snapshots():
    """Events as snapshots of diagnostics."""
    k = _k()
    found = F.array(F.concat(F.lit("e"), (k % 5).cast("string")), F.concat(F.lit("w"), (k % 3).cast("string")), F.lit("all"))
    return {"id": F.col("event_id"), "stream": F.col("event_type"), "found": F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(found)}


def requests():
    """Events as requests whose prefix has one or two elements."""
    k = _k()
    return {"id": F.col("event_id"), "elements": F.when(k % 3 == 0, F.array(F.lit("s"))).when(k % 3 == 1, F.array(F.lit("s"), F.lit("t"))).otherwise(F.array(F.lit("s"), (k % 2).cast("string")))}


def turns():
    """Events as turns: an error starts one, a purchase finishes it, all else is usage."""
    kind = F.when(F.col("event_type") == "error", "start").when(F.col("event_type") == "purchase", "finish").otherwise("usage")
    return {"id": F.col("event_id"), "kind": kind, "message": F.when(_k() % 4 > 0, _k() % 4), "tokens": F.floor("value").cast("long")}


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def observed(events, fold, event, ttl_seconds=None):
    return observers.observe(events, fold, "user_id", "ts", "event_id", event, ttl_seconds)


@query("st2_tool_observer", ORACLE["w6_all_waste_signals"])
def _(spark, d):
    return observed(table(spark, d, "events"), observers.Waste(), calls())


@query(
    "st3_prefix_observer",
    """WITH e AS (SELECT event_id, user_id, ts, CAST(props->>'k' AS INT) AS k FROM events),
 p AS (SELECT *, CASE k % 3 WHEN 0 THEN ['s'] WHEN 1 THEN ['s', 't'] ELSE ['s', CAST(k % 2 AS VARCHAR)] END AS p FROM e),
 l AS (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM p)
 SELECT user_id, event_id, CASE WHEN b IS NULL THEN 'miss' WHEN p = b THEN 'exact' WHEN p[1:len(b)] = b THEN 'extended' ELSE 'miss' END AS reuse,
 CAST(CASE WHEN b IS NULL THEN 0 WHEN len(p) > 1 AND len(b) > 1 AND p[2] = b[2] THEN 2 ELSE 1 END AS BIGINT) AS reused FROM l""",
)
def _(spark, d):
    return observed(table(spark, d, "events"), observers.PrefixReuse(), requests())


@query("st5_diagnostics_observer", ORACLE["st5_diagnostics_delta"])
def _(spark, d):
    return observed(table(spark, d, "events"), observers.Diagnostics(), snapshots()).drop("user_id")


@query(
    "st7_turn_usage",
    """WITH e AS (SELECT event_id, user_id, ts, event_type AS t, CAST(props->>'k' AS INT) % 4 AS m, CAST(floor(value) AS BIGINT) AS v FROM events),
 s AS (SELECT *, max(CASE WHEN t IN ('error', 'purchase') THEN {'ts': ts, 'event_id': event_id, 't': t} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
 u AS (SELECT user_id, b.event_id AS start_id, CASE WHEN m > 0 THEN CAST(m AS VARCHAR) ELSE '-' || event_id END AS m, max(greatest(v, 0)) AS v FROM s WHERE b.t = 'error' AND t NOT IN ('error', 'purchase') GROUP BY 1, 2, 3),
 g AS (SELECT start_id, count(*) AS calls, sum(v) AS tokens FROM u GROUP BY 1)
 SELECT user_id, b.event_id AS start_id, event_id AS finish_id, coalesce(calls, 0) AS calls, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM s LEFT JOIN g ON g.start_id = b.event_id WHERE b.t = 'error' AND t = 'purchase'""",
)
def _(spark, d):
    return observed(table(spark, d, "events"), observers.Turns(), turns())
