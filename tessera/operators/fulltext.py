"""Ranked full-text search over a kept index that skips blocks by their maxima.

Documents are dealt into shards by a hash of their key. The index has one block for each term and shard: the documents with
their BM25 parts (without idf), and the largest part. A query's documents in a shard can't score more than the sum of its
terms' idf times these maxima. So a search reads the small heads first, scores the most promising shards of each query in
full, takes the k-th score found there as a threshold, and reads of the other shards only those whose bound reaches it.
A task that scores a shard for a query hands on at most k rows. The result is that of scoring all documents.

Null terms and keys are not indexed; a query without a known term finds nothing; ties by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import K1, QUERIES, B
from tessera.sources.tables import written

#: Terms are dealt into so many folders, so a search of few terms reads few of them.
BUCKETS = 64
#: Decimals of a score.
PLACES = 6


@dataclass
class FullText:
    blocks: DataFrame  #: term, shard, top, posts (doc, part, tf), bucket; partitioned by bucket
    terms: DataFrame  #: term, df, idf
    n_docs: int
    avg_len: float


def build(counts: DataFrame, key: str = "doc_id", shard_docs: int = 256) -> FullText:
    """Index a table of key, term, tf, and len, if given, the sum of a key's tf. Counts are shuffled by bucket and shard for the blocks, without len by key before."""
    counts = counts.where(F.col(key).isNotNull() & F.col("term").isNotNull())
    total = counts.groupBy(key).agg(F.sum("tf").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    n, avg = total["n"], max(1.0, total["avg"] or 1.0)
    part = F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / avg))
    known = counts if "len" in counts.columns else counts.withColumn("len", F.sum("tf").over(Window.partitionBy(key)))
    posts = known.select("term", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // shard_docs)))).alias("shard"), key, "tf", "len")
    dealt = posts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).withColumn("_s", F.pmod("shard", F.lit(16))).repartition("bucket", "_s")
    post = F.struct(F.col(key).alias("doc"), part.alias("part"), F.col("tf"))  # parts after the shuffle, which small whole numbers pass in less
    blocks = dealt.groupBy("bucket", "_s", "term", "shard").agg(F.max(part).alias("top"), F.collect_list(post).alias("posts"))  # a shard's documents at most
    blocks = written(blocks.select("term", "shard", "top", "posts", "bucket").sortWithinPartitions("bucket", "term"), "blocks", ["bucket"])
    df = blocks.groupBy("term").agg(F.sum(F.size("posts")).alias("df"))
    return FullText(blocks, written(df.withColumn("idf", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "terms"), n, avg)


def _scored(index: FullText, asked: DataFrame, pairs: DataFrame, k: int, places: int) -> DataFrame:
    """query_id, doc, score, matched: the k best of each pair (query_id, shard, least) that reach ``least``.

    A shard's blocks go to one task once, however many queries ask for them; the queries' terms are broadcast in blocks of queries.
    """
    n = asked.select("query_id").distinct().count()
    parts = max(1, -(-n // QUERIES))
    of = lambda df, i: df.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else df
    return reduce(DataFrame.unionByName, [_scored_block(index, of(asked, i), of(pairs, i), k, places) for i in range(parts)])


def _scored_block(index: FullText, asked: DataFrame, pairs: DataFrame, k: int, places: int) -> DataFrame:
    slack = 10.0**-places
    terms: dict = {}
    for r in asked.select("query_id", "term", "idf").collect():  # QUERIES queries at most
        terms.setdefault(r["query_id"], []).append((r["term"], r["idf"]))
    shared = asked.sparkSession.sparkContext.broadcast({q: sorted(t) for q, t in terms.items()})
    wanted = pairs.groupBy("shard").agg(F.collect_list(F.struct("query_id", "least")).alias("asks"))
    met = index.blocks.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").join(wanted.select("shard"), "shard", "left_semi")
    shards = met.groupBy("shard").agg(F.collect_list(F.struct("term", "posts")).alias("blocks")).join(wanted, "shard").select("blocks", "asks")
    q_type = pairs.schema["query_id"].dataType.simpleString()
    d_type = index.blocks.schema["posts"].dataType.elementType["doc"].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                blocks, asks = b.column(0)[i].values, b.column(1)[i].values
                at = {t: j for j, t in enumerate(blocks.field("term").to_pylist())}
                lists = blocks.field("posts")
                start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                posts = lists.flatten()
                codes = posts.field("doc").dictionary_encode()
                doc, part, tf = codes.indices.to_numpy(), posts.field("part").to_numpy(), posts.field("tf").to_numpy()
                size = len(codes.dictionary)
                for q, least in zip(asks.field("query_id").to_pylist(), asks.field("least").to_pylist()):
                    # in the order of the terms, so that sums don't depend on the shuffle
                    own = [(slice(start[at[t]], start[at[t] + 1]), idf) for t, idf in shared.value[q] if t in at]
                    if not own:
                        continue
                    docs = np.concatenate([doc[s] for s, _ in own])
                    score = np.round(np.bincount(docs, np.concatenate([part[s] * idf for s, idf in own]), size), PLACES)
                    matched = np.bincount(docs, np.concatenate([tf[s] for s, _ in own]), size).astype(np.int64)
                    keep = np.flatnonzero((matched > 0) & (score >= least - slack))
                    if len(keep) > k:
                        keep = keep[score[keep] >= np.partition(score[keep], -k)[-k] - slack]  # with all that may tie
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(keep), asks.field("query_id").type), codes.dictionary.take(pa.array(keep)), pa.array(score[keep]), pa.array(matched[keep])], names=["query_id", "doc", "score", "matched"])

    return shards.mapInArrow(best, f"query_id {q_type}, doc {d_type}, score double, matched long")


def search(index: FullText, queries: DataFrame, k: int, first: int = 4, places: int = PLACES) -> DataFrame:
    """query_id, doc, score, matched, rank: the k best documents of each query (query_id, term) by BM25.

    ``first`` shards of each query are scored to find its threshold. Scores that agree to ``places`` decimals tie.
    """
    asked = queries.select("query_id", "term").distinct().join(index.terms, "term").select("query_id", "term", "idf", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    asked = written(asked, "asked")
    heads = index.blocks.select("bucket", "term", "shard", "top").join(asked, ["bucket", "term"])
    bounds = written(heads.groupBy("query_id", "shard").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")), "bounds")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
    start = written(bounds.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= first), "start")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", places)), "doc")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    found = written(ranked(_scored(index, asked, start.select("query_id", "shard", F.lit(0.0).alias("least")), k, places)), "found")
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(start.select("query_id", "shard"), ["query_id", "shard"], "left_anti").join(least, "query_id", "left")
    rest = rest.select("query_id", "shard", F.coalesce("least", F.lit(0.0)).alias("least"), "bound").where(F.col("bound") >= F.col("least") - 10.0**-places)
    return ranked(found.drop("rank").unionByName(_scored(index, asked, rest.drop("bound"), k, places)))
