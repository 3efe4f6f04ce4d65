"""Incremental corpus indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_actions(old: DataFrame, new: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """For each key of either table: reuse (same digest), parse (new or changed) or drop (gone)."""
    o, n = old.select(key, F.col(digest).alias("od"), F.lit(1).alias("o")), new.select(key, F.col(digest).alias("nd"), F.lit(1).alias("n"))
    action = F.when(F.col("n").isNull(), "drop").when(F.col("o").isNotNull() & (F.col("od") == F.col("nd")), "reuse").otherwise("parse")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def walk_files(spark: SparkSession, root: str, pattern: str = "*", skip: str = r"/(node_modules|vendor|dist|build|\.git|\.venv|__pycache__)/") -> DataFrame:
    """path, size, mtime and text of the files below a root, read by Spark; generated and vendored folders are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    own = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))
    return own.where(~F.col("path").rlike(skip))
