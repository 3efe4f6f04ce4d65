"""Vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries are broadcast in blocks of so many, so what is broadcast is bounded.
BLOCK = 2000


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors nearest to each query (query_id, q) by cosine; ties by vec_id.

    A stated query set against all rows, in blocks: each task keeps its own k best of a query before anything is shuffled. Vectors
    of other lengths than the query's, empty and zero vectors have score 0.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        asked = [(r["query_id"], r["q"]) for r in own.select("query_id", "q").collect()]
        shared = vectors.sparkSession.sparkContext.broadcast(asked)  # BLOCK vectors at most
        met = vectors.select("vec_id", "embedding").mapInArrow(_scores(shared, k), f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double")
        met = met.withColumn("score", F.round("score", 6))
        if min_score is not None:
            met = met.where(F.col("score") >= min_score)
        # collapses to a per-task limit: Spark pushes row_number() <= k below the exchange
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        met = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = met if out is None else out.union(met)
    return out


def _scores(shared, k: int):
    """For each query the k best of a block of vectors with all that tie with the last, by one matrix product for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda m: m / np.where(n := np.linalg.norm(m, axis=1, keepdims=True), n, 1)
        ids = [i for i, _ in shared.value]
        asked = pa.array(ids)
        sizes = np.array([len(q or ()) for _, q in shared.value])
        by_size = {s: unit(np.array([q for _, q in shared.value if len(q or ()) == s], np.float64)) for s in set(sizes.tolist()) if s}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                lists = b.column(1)
                found = np.zeros((b.num_rows, len(ids)))
                long = np.array([n or 0 for n in lists.value_lengths().to_pylist()])
                for s, q in by_size.items():
                    rows = np.flatnonzero(long == s)
                    if len(rows):
                        m = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, s)
                        found[np.ix_(rows, np.flatnonzero(sizes == s))] = unit(m) @ q.T
                found = np.round(np.nan_to_num(found), 6)
                least = np.partition(found, -k, axis=0)[-k] if k < len(found) else np.full(len(ids), -np.inf)
                row, at = np.nonzero(found >= least)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(at)), b.column(0).take(pa.array(row)), pa.array(found[row, at])], names=["query_id", "vec_id", "score"])

    return run
