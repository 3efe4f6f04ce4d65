"""Shared plumbing of the training-data operators: shared-folder tables, splits, word rules."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOCAL: list[str] = []
#: Paths written by the calls now running, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session's ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is missing and the master is local (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessera_"))
    return _LOCAL[0]


def new_path(spark: SparkSession, tag: str, result: bool = False) -> str:
    """A path in the shared folder. The ``scratch`` block around it deletes it; a result belongs to the block further out, if any."""
    path = f"{shared_dir(spark)}/tessera_{uuid.uuid4().hex}_{tag}"
    at = len(_SCOPES) - (2 if result else 1)
    if at >= 0:
        _SCOPES[at].append(path)
    return path


def materialise(df: DataFrame, tag: str, result: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read that table back."""
    spark = df.sparkSession
    path = new_path(spark, tag, result)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for results; tables of other calls stay."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, as the contracts ask."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; no word: an empty array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most so many rows: bounds what a step over whole texts holds at once."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back: workers outlive a stage, and those of the next one share their executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8: bit by bit, each byte followed by seven zeros."""
    steps = f"flatten(list_transform(range(cast(octet_length(encode({x})) as bigint)), lambda i: [cast('0x' || substr(hex(encode({x})), 2 * i + 1, 2) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    return f"4294967295 - list_reduce(list_concat([cast(4294967295 as bigint)], {steps}), lambda s, v: xor(xor(s, v) >> 1, 3988292384 * (xor(s, v) & 1)))"
