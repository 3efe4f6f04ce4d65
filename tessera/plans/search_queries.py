"""Queries of kept indexes: approximate vectors, ranked full text, typing errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.ranking_queries import BM25_ALL
from tessera.plans.registry import query, table


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("l3_ann_topk")  # approximate: recall against the exact search is tested, and given by l3_ann_recall
def _(spark, d):
    from tessera.operators import ann

    vectors, asked = _vectors(spark, d)
    return ann.search(ann.build(vectors), asked, 10).withColumnRenamed("id", "vec_id")


@query("l3_ann_recall")
def _(spark, d):
    from tessera.operators import ann
    from tessera.operators.vectors import exact_top_k

    vectors, asked = _vectors(spark, d)
    return ann.recall(ann.search(ann.build(vectors), asked, 10), exact_top_k(asked, vectors, 10).withColumnRenamed("vec_id", "id"))


def _full_text(spark, d):
    """The index over documents, and the benchmark items' terms as queries."""
    from tessera.operators import fulltext
    from tessera.plans.ranking_queries import _asked, _counts

    return fulltext.build(_counts(spark, d)), _asked(spark, d)


_TOP = BM25_ALL + " SELECT query_id, doc_id, score, matched, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM scored) WHERE rank <= {k}"


@query("j7_ranked_search", _TOP.format(k=12))
def _(spark, d):
    from tessera.operators import fulltext

    index, asked = _full_text(spark, d)
    return fulltext.search(index, asked, 12).withColumnRenamed("doc", "doc_id")


def typed_terms(spark, d):
    """query_id, term: the benchmark items' terms, those of five letters or more without their middle one, as typing errors."""
    from tessera.plans.ranking_queries import _asked

    t, n = F.col("term"), F.length("term")
    cut = F.concat(F.substring(t, F.lit(1), F.floor(n / 2).cast("int")), F.substring(t, F.floor(n / 2).cast("int") + 2, n))
    return _asked(spark, d).select("query_id", F.when(n >= 5, cut).otherwise(t).alias("term"))


@query("r0_expanded_terms")  # matching blocks are no SQL: tested against a brute force over the whole vocabulary
def _(spark, d):
    from tessera.functions.text import exploded_terms
    from tessera.operators import typos

    asked = typed_terms(spark, d)
    vocabulary = exploded_terms(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], {"text": (F.col("text"), 1)}).select("term")
    return typos.expanded(asked, typos.corrections(vocabulary, asked))


def ranked_parts(spark, d):
    """query_id, path, rank, score, relevant, priority: each nation's suppliers' parts modulo 100 as a ranking, and edges of the five kinds."""
    from tessera.plans.ranking_queries import _edges

    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("query_id"))
    lines = table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    scored = lines.groupBy("query_id", (F.col("l_partkey") % 100).alias("path")).agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("relevant", F.col("rank") % 3 == 1).withColumn("priority", F.col("path") % 10 == 0)
    edges = _edges(spark, d).withColumn("kind", F.when((F.col("src") + F.col("dst")) % 11 == 0, "semantic-ref").otherwise(F.col("kind"))).distinct()
    return ranked, edges


@query("r8_graph_credit")  # frontiers by query are a loop: tested against a loop over queries
def _(spark, d):
    from tessera.operators.graph import graph_credit

    ranked, edges = ranked_parts(spark, d)
    return graph_credit(ranked, edges).select("query_id", "path", F.round("graph", 6).alias("graph"), "reason")


@query("r13_semantic_credit")  # as r8
def _(spark, d):
    from tessera.operators.graph import semantic_credit

    ranked, edges = ranked_parts(spark, d)
    return semantic_credit(ranked, ranked.where("path % 2 = 0"), edges).select("query_id", "path", F.round("graph", 6).alias("graph"), "reason")
