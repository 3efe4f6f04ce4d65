"""Tables that cut the lineage of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
# Fixed value: about as many rows as a task should sort or aggregate.
TASK_ROWS = 1 << 18


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only under a local master without that setting, as in tests, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessera_tables_"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/tables_{uuid.uuid4().hex}_{tag}"


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a table at a new path, and read back."""
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs more than a shuffle.

    A large table has more splits than that and stays as it is; a small one in a few files or row groups would run in as few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts(df: DataFrame) -> int:
    """How many partitions the rows of a table need for tasks of about ``TASK_ROWS`` rows; one a core at least. The count reads no column."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` by its keys over ``n`` partitions, or over the session's number.

    An aggregation of these keys then needs no part of its own before the shuffle, where a task's rows follow from the size of a file's
    split. A number given is kept: adaptive execution merges partitions by compressed bytes, which say little of a task's memory.
    """
    return df.repartition(n, *keys) if n else df.repartition(*keys)
