"""Lexical and structural ranking, rank fusion and score traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import exploded_terms
from tessera.sources.tables import written

K1, B = 1.5, 0.75
#: Queries whose terms are broadcast at once.
QUERIES = 2000


def document_counts(docs: DataFrame, weights: dict[str, int], outline: bool = False, key: str = "doc_id") -> DataFrame:
    """key, term, tf: weighted term counts over several columns; ``outline`` stands for the first line of the text."""
    text = lambda name: F.substring_index("text", "\n", 1) if name == "outline" and outline else F.col(name)
    return exploded_terms(docs, [key], {name: (text(name), weight) for name, weight in weights.items()}).groupBy(key, "term").agg(F.sum("w").alias("tf"))


def bm25(counts: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, matched for each document with a term of a query (query_id, term: distinct terms).

    counts: key, term, tf, and len, if given, the sum of a key's tf; a table by preference, else it is made from its texts again for
    each use: for the lengths, the document frequencies and the scores. The queries' terms with their idf are broadcast in blocks of
    queries, so postings stay where they are, and only sums by query and document are shuffled.
    """
    lengths = counts.groupBy(key).agg(F.sum("tf").alias("len"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg_len"))  # one row
    sized = counts if "len" in counts.columns else counts.join(lengths, key)
    asked = queries.select("query_id", "term").distinct()
    df = counts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = written(asked.join(df, "term").join(F.broadcast(totals)).select("query_id", "term", idf.alias("idf"), "avg_len"), "asked")
    blocks = max(1, -(-known.select("query_id").distinct().count() // QUERIES))
    part = F.col("idf") * (F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len"))))
    out = None
    for i in range(blocks):
        own = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else known
        met = sized.join(F.broadcast(own), "term").select("query_id", key, "tf", part.alias("part"))
        met = met.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"), F.sum("tf").alias("matched"))
        out = met if out is None else out.unionByName(met)
    return out


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.when(rank <= 0, 0.0).otherwise(1.0 / (k + rank))


def fuse(hits: DataFrame, query: str = "query_id", item: str = "item", k: int = 60, secondary: float = 0.9) -> DataFrame:
    """Reciprocal rank fusion over views (view, rank, score); view 0 has weight 1. Ties: best score, best rank, item."""
    w = F.when(F.col("view") == 0, 1.0).otherwise(secondary)
    out = hits.groupBy(query, item).agg(F.round(F.sum(w * reciprocal_rank(F.col("rank"), k)), 8).alias("fused"), F.max("score").alias("best_score"), F.min("rank").alias("best_rank"), F.countDistinct("view").alias("views"))
    order = Window.partitionBy(query).orderBy(F.desc("fused"), F.desc("best_score"), "best_rank", item)
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def hybrid_boost(rank: Column, similarity: Column, lexical: Column, views: Column, overlap: Column) -> Column:
    """min(34, 700 / (40 + rank) + 8 similarity + 1.75 ln(1 + hits) + 1.25 (min(3, views) - 1) + min(3, 0.75 overlap))."""
    total = 700.0 / (40 + rank) + 8.0 * similarity + 1.75 * F.log1p(lexical) + 1.25 * (F.least(F.lit(3), views) - 1) + F.least(F.lit(3.0), 0.75 * overlap)
    return F.least(F.lit(34.0), total)


def traced(df: DataFrame, start: Column, stages: list[tuple[str, Column]], score: str = "score") -> DataFrame:
    """Apply additive stages and keep, for each, its value before and after as an array of structs."""
    out, before, events = df.withColumn("_s0", start), F.col("_s0"), []
    for i, (name, delta) in enumerate(stages, 1):
        out = out.withColumn(f"_s{i}", before + delta)
        events.append(F.struct(F.lit(name).alias("stage"), before.alias("before"), F.col(f"_s{i}").alias("after"), (F.col(f"_s{i}") - before).alias("delta")))
        before = F.col(f"_s{i}")
    out = out.withColumn(score, before).withColumn("score_trace", F.array(*events))
    return out.drop(*[f"_s{i}" for i in range(len(stages) + 1)])


def top_sum(df: DataFrame, group: str, score: str, k: int, out: str) -> DataFrame:
    """Sum of the k best scores of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    best = df.select(group, score, F.row_number().over(w).alias("_r")).where(F.col("_r") <= k)
    return best.groupBy(group).agg(F.round(F.sum(score), 6).alias(out))


def memory_score(hits: dict[str, Column], confidence: Column, importance: Column, accesses: Column, age_days: Column, half_life: Column) -> Column:
    """(4 claim + 2 applicability + evidence + 2 anchor + 2 tags + bonus)(0.8 + 0.1 importance)(1 + min(0.2, 0.04 ln(1 + accesses)))(0.5 + 0.5 / (1 + age / half-life))."""
    weights = {"claim": 4.0, "applicability": 2.0, "evidence": 1.0, "anchor": 2.0, "tags": 2.0}
    base = reduce(lambda a, b: a + b, [w * hits[k] for k, w in weights.items() if k in hits])
    return (base + confidence) * (0.8 + 0.1 * importance) * (1 + F.least(F.lit(0.2), 0.04 * F.log1p(accesses))) * (0.5 + 0.5 / (1 + age_days / half_life))
