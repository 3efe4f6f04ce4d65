"""Approximate nearest vectors by cosine: an inverted file with product-quantised residuals, re-ranked exactly.

The coarse centroids and the codebooks are fitted on a bounded sample; every vector is indexed. The index is a table
partitioned by list, of blocks of packed codes, so a search reads only the lists that its queries probe, and a list of any
size is many rows. Queries are packed by list too: a task meets a block of queries with a block of codes, sums table
look-ups, and hands on only each query's best candidates, whose true cosine decides.

Vectors that are null, empty, zero, of another length, or not finite are not indexed and find nothing. Repeated ids are
separate candidates and come out once. Ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import written

#: Vectors that centroids and codebooks are fitted on, and the most lists: what every task holds is bounded by both.
SAMPLE, MOST_LISTS = 65_536, 4096
#: Codes of a block, queries of a block, and the blocks of a list that one row of queries meets.
CODES, QUERIES, SHARD = 4096, 256, 16


@dataclass
class Index:
    centroids: np.ndarray  #: lists x dim
    books: np.ndarray  #: parts x entries x width
    blocks: DataFrame  #: shard, ids, codes, list; partitioned by list
    lists: DataFrame  #: list, shards: a row for each list in use, MOST_LISTS at most
    vectors: DataFrame  #: id, unit vector
    probes: int  #: lists that hold 97 % of the sample's ten nearest, see ``_probes``


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, 1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def _probes(x: np.ndarray, centroids: np.ndarray, rng: np.random.Generator, share: float = 0.97, k: int = 10, asked: int = 256) -> int:
    """How many of the nearest lists of a sampled vector hold this share of its k nearest in the sample: few where vectors cluster, many where they don't."""
    q = x[rng.choice(len(x), min(asked, len(x)), replace=False)]
    k = min(k + 1, len(x))
    near = np.argpartition(-(q @ x.T), k - 1, 1)[:, :k]
    order = np.argsort(np.argsort((centroids * centroids).sum(1) / 2 - q @ centroids.T, 1), 1)
    return int(np.quantile(np.take_along_axis(order, _nearest(x, centroids)[near], 1), share)) + 1


def unit(vector: Column, dim: int | None = None) -> Column:
    """A vector scaled to length one; null where it has no direction, or not ``dim`` entries."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = (norm > 0) & (norm < float("inf")) if dim is None else (norm > 0) & (norm < float("inf")) & (F.size(v) == dim)
    return F.when(fine, F.transform(v, lambda x: x / norm))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def build(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", dim: int | None = None, lists: int | None = None, parts: int = 16, seed: int = 0) -> Index:
    """Index all vectors. ``dim`` defaults to the most frequent length, ``lists`` to the square root of their number."""
    if dim is None:
        top = vectors.groupBy(F.size(embedding).alias("s")).count().where("s > 0").orderBy(F.desc("count"), "s").first()
        dim = top["s"] if top else 1
    own = written(vectors.select(F.col(key).alias("id"), unit(F.col(embedding), dim).alias("v")).where("v is not null"), "units")
    n = own.count()
    taken = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()  # a bounded sample, the same in every run
    x = _matrix(taken.column("v").combine_chunks(), dim) if taken.num_rows else np.zeros((1, dim), np.float32)
    rng = np.random.default_rng(seed)
    centroids = _kmeans(x, min(MOST_LISTS, lists or max(1, round(n**0.5))), rng)
    rest = x - centroids[_nearest(x, centroids)]
    parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
    width = dim // parts
    entries = min(256, len(x))
    books = np.stack([_kmeans(np.ascontiguousarray(rest[:, p * width : (p + 1) * width]), entries, rng) for p in range(parts)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), dim)
            at = _nearest(v, centroids)
            r = v - centroids[at]
            codes = np.stack([_nearest(np.ascontiguousarray(r[:, p * width : (p + 1) * width]), books[p]) for p in range(parts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])

    id_type = own.schema["id"].dataType.simpleString()
    coded = written(own.mapInArrow(code, f"list int, id {id_type}, code binary"), "codes")
    size = coded.groupBy("list").agg(F.ceil(F.count("*") / (CODES * SHARD)).cast("int").alias("shards"))  # MOST_LISTS rows at most
    size = written(size, "lists")
    dealt = coded.join(F.broadcast(size), "list").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a list and shard, which come one after the other, as blocks."""
        now, ids, codes = None, [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([now[1]], pa.int32()), pa.array([ids], pa.list_(id_arrow)), pa.array([b"".join(codes)], pa.binary()), pa.array([now[0]], pa.int32())], names=["shard", "ids", "codes", "list"])

        for b in batches:
            id_arrow = b.schema.field("id").type
            for row in zip(*(b.column(c).to_pylist() for c in ("list", "shard", "id", "code"))):
                if now != row[:2] or len(ids) == CODES:
                    if ids:
                        yield block()
                    now, ids, codes = row[:2], [], []
                ids.append(row[2])
                codes.append(row[3])
        if ids:
            yield block()

    blocks = dealt.repartition("list", "shard").sortWithinPartitions("list", "shard", "id").mapInArrow(pack, f"shard int, ids array<{id_type}>, codes binary, list int")
    return Index(centroids, books, written(blocks, "blocks", ["list"]), size, own, _probes(x, centroids, rng))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, candidates: int | None = None, min_score: float | None = None) -> DataFrame:
    """query_id, id, score, rank: about the k nearest vectors of each query (query_id, q), with their exact cosine.

    ``probes`` lists are read for a query (the index's own number by default), and the best ``candidates`` (20 k) by code are re-ranked.
    """
    centroids, books = index.centroids, index.books
    (n_lists, dim), (parts, entries, width) = centroids.shape, books.shape
    probes, keep = min(probes or index.probes, n_lists), candidates or 20 * k
    q_type, id_type = queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centroids * centroids).sum(1) / 2
        for b in batches:
            v = _matrix(b.column(1), dim)
            near = np.argpartition(half - v @ centroids.T, probes - 1, 1)[:, :probes] if probes < n_lists else np.tile(np.arange(n_lists), (len(v), 1))
            row = pa.array(np.repeat(np.arange(len(v)), probes))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).take(row), pa.array([x.tobytes() for x in v], pa.binary()).take(row)], names=["list", "query_id", "q"])

    asked = written(queries.select("query_id", unit(F.col("q"), dim).alias("v")).where("v is not null"), "asked")
    probed = asked.mapInArrow(probe, f"list int, query_id {q_type}, q binary")
    # queries of a list in groups by number, so that no row grows with the number of queries
    place = F.row_number().over(Window.partitionBy("list", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id"))
    grouped = probed.withColumn("g", F.floor(place / QUERIES)).withColumn("h", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    packed = grouped.groupBy("list", "h", "g").agg(F.collect_list(F.struct("query_id", "q")).alias("own"))  # QUERIES at most
    packed = packed.join(F.broadcast(index.lists), "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = packed.join(index.blocks, ["list", "shard"]).select("list", F.col("own.query_id").alias("query_ids"), F.col("own.q").alias("qs"), "ids", "codes")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, q_ids, ids = b.column("list")[i].as_py(), b.column("query_ids")[i].values, b.column("ids")[i].values
                rest = np.frombuffer(b"".join(b.column("qs")[i].as_py()), np.float32).reshape(-1, dim) - centroids[at]
                codes = np.frombuffer(b.column("codes")[i].as_py(), np.uint8).reshape(-1, parts)
                far = np.zeros((len(rest), len(codes)), np.float32)
                for p in range(parts):
                    table = ((rest[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2)
                    far += table[:, codes[:, p]]
                best = np.argpartition(far, keep - 1, 1)[:, :keep] if keep < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(far), 1))
                row = np.repeat(np.arange(len(far)), best.shape[1])
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), ids.take(pa.array(best.ravel())), pa.array(far[row, best.ravel()].astype(np.float64))], names=["query_id", "id", "far"])

    near = met.mapInArrow(scores, f"query_id {q_type}, id {id_type}, far double")
    first = Window.partitionBy("query_id").orderBy("far", "id")
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).select("query_id", "id").distinct()
    exact = near.join(index.vectors.dropDuplicates(["id"]), "id").join(asked.withColumnRenamed("v", "q").dropDuplicates(["query_id"]), "query_id")
    score = F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6)
    out = exact.select("query_id", "id", score.alias("score"))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "id") -> DataFrame:
    """One row: n_queries, n_exact, n_found, recall of ``found`` against ``exact`` (query_id, key)."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
