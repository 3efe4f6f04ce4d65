"""Queries of ranking, graphs, budgets, compaction and experiment statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.plans.text_queries import TERMS_SQL
from tessera.sources.tables import written

_COUNTS = f"counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY 1, 2)"
_BM25 = f"""WITH {_COUNTS}, len AS (SELECT doc_id, sum(tf) AS len FROM counts GROUP BY 1), tot AS (SELECT count(*) AS n_docs, greatest(1.0::DOUBLE, avg(len)) AS avg_len FROM len),
 q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS_SQL}) AS term FROM benchmark WHERE item_id % 50 = 0),
 df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1)
 SELECT query_id, c.doc_id, round(sum(ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 6) AS score, CAST(sum(tf) AS BIGINT) AS matched
 FROM counts c JOIN q ON c.term = q.term JOIN df ON df.term = c.term JOIN len ON len.doc_id = c.doc_id CROSS JOIN tot GROUP BY 1, 2"""

#: The scores of all benchmark items and documents, as ``scored``.
BM25_ALL = "WITH scored AS (" + _BM25.replace(" WHERE item_id % 50 = 0", "") + ")"


def _counts(spark, d):
    """doc_id, term, tf, len: texts are dealt by document once, so terms and lengths are counted where they are."""
    from tessera.operators.ranking import document_counts

    docs = table(spark, d, "documents").select("doc_id", "text")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    counts = document_counts(docs.repartition(n, "doc_id"), {"text": 1})
    return written(counts.withColumn("len", F.sum("tf").over(Window.partitionBy("doc_id"))), "counts")


def _asked(spark, d, condition: str = "true"):
    """query_id, term: the distinct terms of the benchmark items; by default of all."""
    from tessera.functions.text import terms

    return table(spark, d, "benchmark").where(condition).select(F.col("item_id").alias("query_id"), F.explode(terms(F.col("text"))).alias("term")).distinct()


def _ranked(scores, k: int):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 4)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


@query("r1_bm25", _BM25)  # the stated query set of a search; r1_bm25_all asks every item
def _(spark, d):
    from tessera.operators.ranking import bm25

    return bm25(_counts(spark, d), _asked(spark, d, "item_id % 50 = 0"))


@query("r1_bm25_all")
def _(spark, d):
    from tessera.operators.ranking import bm25

    return bm25(_counts(spark, d), _asked(spark, d))


@query("r7_top_documents", f"SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS BIGINT) AS rank FROM ({_BM25})) WHERE rank <= 12")
def _(spark, d):
    from tessera.operators.ranking import bm25

    return _ranked(bm25(_counts(spark, d), _asked(spark, d, "item_id % 50 = 0")), 12)


@query("r7_top_documents_all", f"{BM25_ALL} SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS BIGINT) AS rank FROM scored) WHERE rank <= 12")
def _(spark, d):
    from tessera.operators import fulltext

    found = fulltext.search(fulltext.build(_counts(spark, d)), _asked(spark, d), 12, places=4)
    return found.select("query_id", F.col("doc").alias("doc_id"), "rank")


_BOOSTS = "SELECT p_partkey, 8 * CAST(p_name LIKE '%1%' AS INT) AS path_boost, 5 * len(list_intersect(string_split(p_type, ' '), ['STEEL', 'BRASS'])) AS symbol_boost, round(greatest(0, 1.2 - 0.3 * (p_size % 4)), 6) AS priority FROM part"


@query("r2_r6_r21_score_trace", f"SELECT p_partkey, round((path_boost + symbol_boost + priority) * CASE WHEN (SELECT max(1)) = 1 THEN 1 END, 6) AS score, 3 AS stages FROM ({_BOOSTS})")
def _(spark, d):
    from tessera.operators.ranking import traced

    p = table(spark, d, "part")
    stages = [
        ("path", 8.0 * F.col("p_name").contains("1").cast("int")),
        ("symbol", 5.0 * F.size(F.array_intersect(F.split("p_type", " "), F.array(F.lit("STEEL"), F.lit("BRASS"))))),
        ("priority", F.greatest(F.lit(0.0), 1.2 - 0.3 * (F.col("p_size") % 4))),
    ]
    out = traced(p, F.lit(0.0), stages)
    return out.select("p_partkey", F.round("score", 6).alias("score"), F.size("score_trace").alias("stages"))


@query("r10_hybrid_boost", "SELECT l_orderkey, l_linenumber, round(least(34.0, 700.0::DOUBLE / (40 + l_linenumber) + 8.0 * l_discount + 1.75 * ln(1 + l_quantity) + 1.25 * (least(3, l_linenumber) - 1) + least(3.0, 0.75 * l_tax)), 6) AS boost FROM lineitem")
def _(spark, d):
    from tessera.operators.ranking import hybrid_boost

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(hybrid_boost(F.col("l_linenumber"), F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax")), 6).alias("boost"))


@query("r12_rrf", "WITH h AS (SELECT o_custkey AS query_id, o_orderpriority AS item, CAST(o_orderkey % 2 AS INT) AS view, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice AS score FROM orders), f AS (SELECT query_id, item, round(sum(CASE WHEN view = 0 THEN 1.0 ELSE 0.9 END * (1.0::DOUBLE / (60 + rank))), 8) AS fused, max(score) AS best_score, min(rank) AS best_rank FROM h GROUP BY 1, 2) SELECT query_id, item, fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, best_score DESC, best_rank, item) AS BIGINT) AS rank FROM f")
def _(spark, d):
    from tessera.operators.ranking import fuse

    view = (F.col("o_orderkey") % 2).cast("int")
    w = Window.partitionBy("o_custkey", view).orderBy(F.desc("o_totalprice"), "o_orderkey")
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("item"), view.alias("view"), F.row_number().over(w).alias("rank"), F.col("o_totalprice").alias("score"))
    return fuse(hits).select("query_id", "item", "fused", "rank")


@query("r23_workspace_score", "SELECT source, round(sum(n_chars), 6) AS score FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC) AS rk FROM documents) WHERE rk <= 3 GROUP BY 1")
def _(spark, d):
    from tessera.operators.ranking import top_sum

    return top_sum(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("double")), "source", "n_chars", 3, "score")


@query("r24_memory_score", "SELECT o_orderkey, round((4.0 * (o_orderpriority = '1-URGENT')::INT + 2.0 * (o_orderstatus = 'F')::INT + 0.5) * (0.8 + 0.1 * (o_orderkey % 5)) * (1 + least(0.2::DOUBLE, 0.04 * ln(1 + o_custkey))) * (0.5 + 0.5 / (1 + (o_orderkey % 400) / 180.0::DOUBLE)), 6) AS score FROM orders")
def _(spark, d):
    from tessera.operators.ranking import memory_score

    hits = {"claim": (F.col("o_orderpriority") == "1-URGENT").cast("int"), "applicability": (F.col("o_orderstatus") == "F").cast("int")}
    return table(spark, d, "orders").select("o_orderkey", F.round(memory_score(hits, F.lit(0.5), F.col("o_orderkey") % 5, F.col("o_custkey"), F.col("o_orderkey") % 400, F.lit(180.0)), 6).alias("score"))


@query("r25_j18_ranking_diff", "WITH a AS (SELECT o_custkey AS task, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_custkey AS task, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 7 <> 0) SELECT coalesce(a.task, b.task) AS task, coalesce(a.path, b.path) AS path, b.r - a.r AS drop FROM a FULL JOIN b ON a.task = b.task AND a.path = b.path")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("path"), "o_totalprice")
    w = Window.partitionBy("task").orderBy(F.desc("o_totalprice"), "path")
    side = lambda cond, name: o.where(cond).select("task", "path", F.row_number().over(w).cast("long").alias(name))
    both = side("path % 5 <> 0", "a").join(side("path % 7 <> 0", "b"), ["task", "path"], "full_outer")
    return both.select("task", "path", (F.col("b") - F.col("a")).alias("drop"))


# ---- graphs ----------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst, CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'imports' WHEN 1 THEN 'imported-by' WHEN 2 THEN 'calls-symbol' ELSE 'calls' END AS kind FROM lineitem)"


def _edges(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in ("imports", "imported-by", "calls-symbol", "calls")]), (F.col("l_linenumber") % 4).cast("int"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), kind.alias("kind")).distinct()


@query("gr1_neighbors", f"WITH {_EDGES} SELECT src, dst, kind FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY CASE kind WHEN 'imported-by' THEN 1 WHEN 'imports' THEN 2 WHEN 'calls-symbol' THEN 3 ELSE 4 END) AS rk FROM e WHERE src <> dst) WHERE rk = 1")
def _(spark, d):
    from tessera.operators.graph import neighbors

    return neighbors(_edges(spark, d))


_GR2 = f"""WITH {_EDGES}, w AS (SELECT *, CASE kind WHEN 'imports' THEN 0.95::DOUBLE WHEN 'imported-by' THEN 0.9 WHEN 'calls-symbol' THEN 0.9 ELSE 0.85 END AS c FROM e),
 l1 AS (SELECT dst AS path, 1 AS distance, max(c) AS confidence FROM w WHERE src = 3 AND dst <> 3 GROUP BY 1),
 l2 AS (SELECT dst AS path, 2 AS distance, max(c) * 0.75 AS confidence FROM w JOIN l1 ON w.src = l1.path WHERE dst <> 3 AND dst NOT IN (SELECT path FROM l1) GROUP BY 1)
 SELECT path, distance, round(confidence, 6) AS confidence FROM l1 UNION ALL SELECT path, distance, round(confidence, 6) FROM l2"""


@query("gr2_closure", _GR2)
def _(spark, d):
    from tessera.operators.graph import closure

    return closure(_edges(spark, d), spark.range(3, 4).select(F.col("id").alias("path")), 2).select("path", "distance", F.round("confidence", 6).alias("confidence"))


@query("gr4_impact", f"WITH {_EDGES} SELECT dst AS path, max(CASE kind WHEN 'imported-by' THEN 0.95::DOUBLE WHEN 'calls-symbol' THEN 0.9 ELSE 0.75 END) AS confidence FROM e WHERE src IN (1, 2) AND dst NOT IN (1, 2) GROUP BY 1")
def _(spark, d):
    from tessera.operators.graph import impact

    return impact(_edges(spark, d), spark.range(1, 3).select(F.col("id").alias("path")))


@query("gr3_providers", "SELECT DISTINCT l_partkey % 100 AS path FROM lineitem WHERE l_linenumber % 4 = 0 AND l_suppkey = 5 AND l_partkey % 100 <> 5")
def _(spark, d):
    from tessera.operators.graph import providers

    edges = _edges(spark, d).withColumn("kind", F.when(F.col("kind") == "imports", "semantic-ref").otherwise(F.col("kind")))
    return providers(edges, spark.range(5, 6).select(F.col("id").alias("path")))


@query("gr9_missing_dependencies", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1, 2")
def _(spark, d):
    deps = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return deps.join(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


# ---- budgets ---------------------------------------------------------------------------------------------------------


@query("b5_largest_remainder", "WITH g AS (SELECT s_nationkey, s_suppkey, s_name, CAST(s_suppkey % 7 + 1 AS BIGINT) AS w FROM supplier), r AS (SELECT *, greatest(0, 1000 - 10 * count(*) OVER p) * (w / sum(w) OVER p::DOUBLE) AS raw, greatest(0, 1000 - 10 * count(*) OVER p) AS rest FROM g WINDOW p AS (PARTITION BY s_nationkey)), k AS (SELECT *, rest - sum(floor(raw)) OVER (PARTITION BY s_nationkey) AS lft, row_number() OVER (PARTITION BY s_nationkey ORDER BY round(raw - floor(raw), 9) DESC, s_name DESC) AS rk FROM r) SELECT s_suppkey, CAST(10 + floor(raw) + (rk <= lft)::INT AS BIGINT) AS tokens FROM k")
def _(spark, d):
    from tessera.operators.budget import largest_remainder

    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", (F.col("s_suppkey") % 7 + 1).alias("w"), F.lit(1000).alias("total"))
    return largest_remainder(s, ["s_nationkey"], "s_name", "w", "total", 10).select("s_suppkey", "tokens")


@query("b3_coverage_target", "SELECT o_orderkey, least(12, o_custkey, CAST(floor(o_totalprice / 300) AS BIGINT)) AS target FROM orders")
def _(spark, d):
    from tessera.operators.budget import coverage_target

    return table(spark, d, "orders").select("o_orderkey", coverage_target(F.lit(12), F.col("o_custkey"), F.col("o_totalprice")).cast("long").alias("target"))


@query("b8_rewrite_value", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.1 * l_quantity - (l_extendedprice * 0.5 * 1.25 + l_extendedprice * 0.5 * 0.1 * greatest(l_quantity - 1, 0)), 6) AS value FROM lineitem")
def _(spark, d):
    from tessera.operators.budget import rewrite_value

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(rewrite_value(F.col("l_extendedprice"), F.col("l_extendedprice") * 0.5, F.col("l_quantity")), 6).alias("value"))


@query("b10_cheapest_model", "SELECT l_orderkey, l_linenumber, p_brand FROM (SELECT l_orderkey, l_linenumber, p_brand, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY rate, p_brand) AS rk FROM lineitem JOIN (SELECT p_brand, min(p_retailprice) AS rate, max(p_size) AS cap FROM part GROUP BY 1) r ON r.cap >= l_quantity WHERE l_linenumber = 1) WHERE rk = 1")
def _(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_quantity")
    rates = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("rate"), F.max("p_size").alias("cap"))
    met = li.join(rates, F.col("cap") >= F.col("l_quantity"))
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("rate", "p_brand")).alias("b")).select("l_orderkey", "l_linenumber", F.col("b.p_brand").alias("p_brand"))


@query("a12_visual_tokens", "SELECT p_partkey, CAST(ceil(p_size * 30 / 28.0::DOUBLE) * ceil(p_retailprice / 28.0::DOUBLE) AS BIGINT) AS tokens FROM part")
def _(spark, d):
    from tessera.operators.budget import visual_tokens

    return table(spark, d, "part").select("p_partkey", visual_tokens(F.col("p_size") * 30, F.col("p_retailprice")).alias("tokens"))


@query("b1_context_pack")
def _(spark, d):
    from tessera.functions.text import estimate_tokens, identifier_tokens
    from tessera.operators.budget import greedy_pack
    from tessera.operators.ranking import bm25

    best = _ranked(bm25(_counts(spark, d), _asked(spark, d)), 48)
    own = table(spark, d, "documents").join(best, "doc_id").select("query_id", "rank", estimate_tokens(F.col("text")).alias("tokens"), identifier_tokens(F.col("text")).alias("terms"))
    return greedy_pack(own, ["query_id"], "rank", "tokens", "terms", 6000)


# ---- statistics ------------------------------------------------------------------------------------------------------


@query("x7_arm_assignment", "SELECT c_custkey, CASE WHEN CAST(CAST('0x' || sha256('exp:' || CAST(c_custkey AS VARCHAR))[1:16] AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE < 0.2 THEN 'control' ELSE 'treatment' END AS arm FROM customer")
def _(spark, d):
    from tessera.operators.stats import arm_of

    return table(spark, d, "customer").select("c_custkey", arm_of("exp", F.col("c_custkey").cast("string"), 0.2).alias("arm"))


@query("x2_cluster_bootstrap")
def _(spark, d):
    from tessera.operators.stats import cluster_bootstrap

    totals = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("cost"), F.count_if(F.col("o_orderstatus") == "F").alias("wins"))
    return cluster_bootstrap(totals, "o_custkey", "cost", "wins", 400)


@query("x8_quality_gate", "WITH q AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS b, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS o FROM orders GROUP BY 1) SELECT o_custkey, o >= b - 10000 AS passed FROM q")
def _(spark, d):
    side = lambda r: F.avg(F.when(F.col("o_orderkey") % 2 == r, F.col("o_totalprice")))
    q = table(spark, d, "orders").groupBy("o_custkey").agg(side(0).alias("b"), side(1).alias("o"))
    return q.select("o_custkey", (F.col("o") >= F.col("b") - 10000).alias("passed"))


@query("x14_quality_manifest", "SELECT doc_id, text LIKE '%the%' AND text LIKE '%and%' AS preserved, text LIKE '%token = %' AS introduced, length(text) / 3.5 <= 600 AS within FROM documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (t.contains("the") & t.contains("and")).alias("preserved"), t.contains("token = ").alias("introduced"), (F.length(t) / 3.5 <= 600).alias("within"))


@query("k11_quality_summary", "SELECT source, round(avg(quality) * 0.6 + (1 - avg(toxic)) * 0.4, 6) AS score, count(*) AS graded FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.round(F.avg("quality") * 0.6 + (1 - F.avg("toxic")) * 0.4, 6).alias("score"), F.count("*").alias("graded"))


@query("k4_unused", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_anti")


@query("k5_freshness", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS newest, max(ts) > TIMESTAMP '2024-01-20' AS stale FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return g.select("user_id", F.col("m.event_id").alias("newest"), (F.col("m.ts") > F.lit("2024-01-20").cast("timestamp")).alias("stale"))


@query("k6_trial", "SELECT o_orderpriority, round(1 - avg(o_totalprice) FILTER (WHERE o_custkey % 2 = 1) / nullif(avg(o_totalprice) FILTER (WHERE o_custkey % 2 = 0), 0), 6) AS reduction FROM orders GROUP BY 1")
def _(spark, d):
    side = lambda r: F.avg(F.when(F.col("o_custkey") % 2 == r, F.col("o_totalprice")))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(1 - F.try_divide(side(1), F.nullif(side(0), F.lit(0.0))), 6).alias("reduction"))


@query("k8_live_status", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 5 THEN 'WATCH' ELSE 'OK' END AS status, round(count(*) FILTER (WHERE event_type = 'view') / nullif(count(*) FILTER (WHERE event_type IN ('view', 'click')), 0)::DOUBLE, 6) AS reuse FROM events GROUP BY 1")
def _(spark, d):
    t = F.col("event_type")
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(t == "error").alias("e"), F.count_if(t == "view").alias("h"), F.count_if(t.isin("view", "click")).alias("a"))
    return g.select("user_id", F.when(F.col("e") >= 5, "WATCH").otherwise("OK").alias("status"), F.round(F.try_divide("h", F.nullif("a", F.lit(0))), 6).alias("reuse"))


@query("k10_latest_checkpoint", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("event_type"))


@query("k14_latest_user_text", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("k15_prefix_hashes", "SELECT conv_id, turn, sha256(text) AS element FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("element"))


# ---- compaction and streaming ----------------------------------------------------------------------------------------


@query("p10_route_processors", "WITH p(name, priority, rx, hf) AS (VALUES ('error-log', 10, 'error', true), ('view-log', 20, 'view|click', false), ('any', 90, '.', true)) SELECT event_id, coalesce(name, 'generic') AS processor FROM (SELECT event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY priority, name) AS rk FROM events LEFT JOIN p ON regexp_matches(event_type, rx) AND (value <= 50 OR hf)) WHERE rk = 1")
def _(spark, d):
    from tessera.operators.compaction import route_processors

    dim = spark.createDataFrame([("error-log", 10, "error", True), ("view-log", 20, "view|click", False), ("any", 90, ".", True)], "name string, priority int, command_regex string, handles_failure boolean")
    out = table(spark, d, "events").select("event_id", "event_type", (F.col("value") > 50).alias("failed"))
    return route_processors(out, dim, "event_type", "failed").select("event_id", "processor")


@query("p_line_runs", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS grp FROM l) SELECT doc_id, min(i) AS start, line, count(*) AS n FROM g GROUP BY doc_id, line, grp HAVING count(*) >= 3 AND trim(line) <> ''")
def _(spark, d):
    from tessera.operators.compaction import collapsed_runs

    return collapsed_runs(table(spark, d, "documents"), "doc_id")


@query("st1_stream_dedup", "SELECT user_id, event_type, props, min(event_id) AS first_id FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    from tessera.streaming.state import first_of_each

    return first_of_each(table(spark, d, "events"), ["user_id", "event_type", "props"], "event_id")


@query("st10_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from tessera.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 hour").select("start_at", "event_type", "n", F.round("total", 4).alias("total"))


@query("st10_sessions", "WITH e AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800 THEN 0 ELSE 1 END AS f FROM events), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM g GROUP BY user_id, s")
def _(spark, d):
    from tessera.streaming.windows import sessions

    return sessions(table(spark, d, "events"), "30 minutes")
