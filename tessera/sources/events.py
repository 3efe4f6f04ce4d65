"""Event logs: tolerant loading, bounded retention, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "type STRING, subtype STRING, timestamp STRING, message STRUCT<id STRING, model STRING, usage STRUCT<input_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT, output_tokens: BIGINT>>"


def valid_events(events: DataFrame, since: str | None = None, json: str = "props", at: str = "ts") -> DataFrame:
    """Rows whose payload parses as JSON, and from a point in time on; a missing time is left out then."""
    out = events.where(F.try_parse_json(json).isNotNull())
    return out if since is None else out.where(F.col(at) >= F.lit(since).cast("timestamp"))


def newest(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest n rows: a top-k, not a full sort."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one file a session; lines that don't parse are skipped."""
    rows = spark.read.text(path).select(F.input_file_name().alias("session"), F.from_json("value", TRANSCRIPT).alias("r"))
    return rows.where("r.type is not null").select("session", "r.*")


def append_events(events: DataFrame, path: str) -> None:
    """Append with a schema number and the time of writing."""
    events.withColumn("schema", F.lit(1)).withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)
