"""Queries of joins, aggregations, windows, top-k and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query, table

ROUND = 4


# ---- joins -----------------------------------------------------------------------------------------------------------


_RUNS = """runs AS (SELECT o_custkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'opt' END AS arm, avg(o_totalprice) AS cost, bool_and(o_orderstatus <> 'P') AS ok, count(*) AS n FROM orders GROUP BY 1, 2)"""


def _runs(spark, d):
    o = table(spark, d, "orders")
    arm = F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("opt")
    return o.groupBy(F.col("o_custkey").alias("task"), arm.alias("arm")).agg(F.avg("o_totalprice").alias("cost"), F.bool_and(F.col("o_orderstatus") != "P").alias("ok"), F.count("*").alias("n"))


@query("j1_x1_paired_costs", f"WITH {_RUNS} SELECT b.task, round(b.cost, 6) AS base, round(o.cost, 6) AS other, round(1 - o.cost / b.cost, 6) AS reduction FROM runs b JOIN runs o ON b.task = o.task AND b.arm = 'base' AND o.arm = 'opt'")
def _(spark, d):
    from tessera.operators.stats import paired

    p = paired(_runs(spark, d), ["task"], "arm", "base", "opt", "cost")
    return p.select("task", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), F.round(1 - F.col("other") / F.col("base"), 6).alias("reduction"))


@query("j2_missing_pairs", f"WITH {_RUNS} SELECT coalesce(b.task, o.task) AS task, CASE WHEN b.task IS NULL THEN 'base' ELSE 'opt' END AS missing FROM (SELECT * FROM runs WHERE arm = 'base') b FULL JOIN (SELECT * FROM runs WHERE arm = 'opt') o ON b.task = o.task WHERE b.task IS NULL OR o.task IS NULL")
def _(spark, d):
    arms = _runs(spark, d).groupBy("task").agg(F.bool_or(F.col("arm") == "base").alias("b"), F.bool_or(F.col("arm") == "opt").alias("o"))
    return arms.where("not (b and o)").select("task", F.when(~F.col("b"), "base").otherwise("opt").alias("missing"))


@query("j3_call_results", "SELECT a.conv_id, a.turn, length(b.text) AS result_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def _(spark, d):
    c = table(spark, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("result_chars"))
    return c.where("role = 'user'").select("conv_id", "turn").join(b, ["conv_id", "turn"])


@query("j4_priced", "SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice, 4) AS cost FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rates = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(rates, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("p_retailprice"), 4).alias("cost"))


@query("j8_points_in_spans", "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_suppkey BETWEEN p_partkey AND p_partkey + p_size % 4 WHERE l_linenumber = 1")
def _(spark, d):
    from tessera.operators.intervals import points_in_intervals

    points = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_suppkey")
    spans = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size") % 4).alias("z"))
    return points_in_intervals(points, spans, [], "l_suppkey", "a", "z", 64).select("l_orderkey", "l_linenumber", "p_partkey")


@query("j9_containment", "SELECT a.l_orderkey, a.l_linenumber AS inner_line, b.l_linenumber AS outer_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND b.l_shipdate <= a.l_shipdate AND a.l_shipdate + INTERVAL 5 DAY <= b.l_shipdate + INTERVAL 30 DAY")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    a, b = li.toDF("l_orderkey", "inner_line", "s"), li.toDF("l_orderkey", "outer_line", "t")
    inside = (F.col("t") <= F.col("s")) & (F.col("s") + F.expr("INTERVAL 5 DAYS") <= F.col("t") + F.expr("INTERVAL 30 DAYS"))
    return a.join(b, "l_orderkey").where((F.col("inner_line") != F.col("outer_line")) & inside).select("l_orderkey", "inner_line", "outer_line")


@query(
    "j10_narrowest_overlap",
    "SELECT l_orderkey, x, y FROM (SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY b.l_quantity, b.l_linenumber) AS rk FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND a.l_partkey < b.l_partkey + b.l_quantity AND b.l_partkey < a.l_partkey + 200) WHERE rk = 1",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a, b = li.toDF("l_orderkey", "x", "p", "q"), li.toDF("l_orderkey", "y", "p2", "q2")
    met = a.join(b, "l_orderkey").where("x <> y and p < p2 + q2 and p2 < p + 200")
    return met.groupBy("l_orderkey", "x").agg(F.min(F.struct("q2", "y")).alias("b")).select("l_orderkey", "x", F.col("b.y").alias("y"))


@query(
    "j12_as_of_previous",
    "SELECT event_id, lag(event_id) OVER w AS previous, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0::DOUBLE, 3) AS idle FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
)
def _(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("previous"), F.round((at - F.lag(at).over(w)) / 1e6, 3).alias("idle"))


@query(
    "j12_as_of_join",
    "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, user_id, ts FROM events WHERE event_type = 'view') SELECT event_id, view_id FROM (SELECT p.event_id, v.view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.view_id DESC) AS rk FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts) WHERE rk = 1",
)
def _(spark, d):
    from tessera.operators.asof import as_of

    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return as_of(left, right, ["user_id"], "ts", ["view_id"]).select("event_id", "view_id")


@query(
    "j13_snapshot_diff",
    "WITH a AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'NEW' WHEN b.id IS NULL THEN 'RESOLVED' WHEN a.v = b.v THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM a FULL JOIN b ON a.id = b.id",
)
def _(spark, d):
    from tessera.operators.snapshots import diff

    o = table(spark, d, "orders")
    side = lambda cond: o.where(cond).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    return diff(side("o_orderkey % 3 <> 0"), side("o_orderkey % 3 <> 1"), ["id"], "v")


@query("j14_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j15_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j17_package_edges", "SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM (SELECT s_nationkey AS n_nationkey, 'NATION_' || CAST(s_suppkey % 25 AS VARCHAR) AS dep FROM supplier) a JOIN (SELECT n_nationkey, n_name FROM nation) b ON lower(a.dep) = lower(b.n_name) WHERE a.n_nationkey <> b.n_nationkey")
def _(spark, d):
    from tessera.operators.graph import package_edges

    deps = table(spark, d, "supplier").select(F.col("s_nationkey").alias("repo"), F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 25).cast("string")).alias("dependency"))
    return package_edges(table(spark, d, "nation").select(F.col("n_nationkey").alias("repo"), F.col("n_name").alias("identity")), deps)


# ---- aggregations ----------------------------------------------------------------------------------------------------


@query("g1_usage_dedup", "WITH m AS (SELECT l_suppkey, l_orderkey, max(l_quantity) AS q, max(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(sum(q), 4) AS q, round(sum(e), 4) AS e FROM m GROUP BY 1")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("e"))
    return m.groupBy("l_suppkey").agg(F.round(F.sum("q"), 4).alias("q"), F.round(F.sum("e"), 4).alias("e"))


@query("g2_by_tool", "SELECT event_type, round(sum(value), 4) AS tokens, count(*) AS calls FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("tokens"), F.count("*").alias("calls"))


@query("g3_duplicate_reads", "SELECT user_id, props, count(*) AS n, round(arg_min(value, event_id) * (count(*) - 1), 4) AS waste FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "props").agg(F.count("*").alias("n"), F.round(F.min_by("value", "event_id") * (F.count("*") - 1), 4).alias("waste")).where("n > 1")


@query("g4_hit_rate", "SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'view') / nullif(sum(value), 0), 0), 6) AS rate FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), F.nullif(F.sum("value"), F.lit(0.0))), F.lit(0.0)), 6).alias("rate"))


@query("g5_g6_run_summary", "SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS success_rate, round(CASE WHEN count(o_totalprice) = count(*) THEN sum(o_totalprice) END, 4) AS cost, round(CASE WHEN count(o_totalprice) = count(*) THEN sum(o_totalprice) END / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0), 4) AS cost_per_success, round(avg(o_totalprice), 4) AS mean_latency, round(quantile_cont(o_totalprice, 0.5), 4) AS median_latency FROM orders GROUP BY 1")
def _(spark, d):
    from tessera.operators.stats import summary

    return summary(table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), ["o_orderpriority"], "ok", "o_totalprice", "o_totalprice")


@query("g7_group_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) FILTER (WHERE l_tax > 0.02) AS measured, round(sum(l_quantity) FILTER (WHERE l_tax > 0.02), 4) AS total, round(quantile_cont(l_quantity, 0.9), 4) AS p90, round(avg((l_discount <= 0.05)::INT), 6) AS met FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    m = F.col("l_tax") > 0.02
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(m).alias("measured"), F.round(F.sum(F.when(m, F.col("l_quantity"))), 4).alias("total"), F.round(F.percentile("l_quantity", F.lit(0.9)), 4).alias("p90"), F.round(F.avg((F.col("l_discount") <= 0.05).cast("int")), 6).alias("met"))


@query("g10_observability", "SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value >= 50) AS status_5xx, count(*) FILTER (WHERE value < 50) AS status_2xx, round(quantile_cont(value, 0.5), 4) AS p50 FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") >= 50).alias("status_5xx"), F.count_if(F.col("value") < 50).alias("status_2xx"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"))


@query("g12_opportunities", "SELECT kind, tokens FROM (SELECT 'views' AS kind, round(sum(value), 4) AS tokens FROM events WHERE event_type = 'view' UNION ALL SELECT 'errors', round(sum(value), 4) FROM events WHERE event_type = 'error' UNION ALL SELECT 'none', NULL) t")
def _(spark, d):
    e = table(spark, d, "events")
    sums = e.where("event_type in ('view', 'error')").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("tokens"))
    none = spark.range(1).select(F.lit("none").alias("kind"), F.lit(None).cast("double").alias("tokens"))
    return sums.select(F.concat("event_type", F.lit("s")).alias("kind"), "tokens").unionByName(none).orderBy(F.desc_nulls_last("tokens"))


_IDLE = "i AS (SELECT user_id, event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS idle FROM events)"


@query("g13_cache_ttl", f"WITH {_IDLE}, lo AS (SELECT user_id, max(idle) FILTER (WHERE event_type = 'view') AS lower, count(*) FILTER (WHERE event_type = 'view' AND idle IS NOT NULL) AS hits FROM i GROUP BY 1) SELECT lo.user_id, round(lower, 3) AS lower, hits, round(min(idle) FILTER (WHERE event_type = 'error' AND idle >= lower), 3) AS upper FROM lo JOIN i ON lo.user_id = i.user_id GROUP BY 1, lower, hits")
def _(spark, d):
    from tessera.operators.sessions import cache_ttl

    return cache_ttl(table(spark, d, "events"), "user_id", "view", "error")


@query("g14_x6_stratified", "WITH u AS (SELECT o_orderpriority AS stratum, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2, 3), s AS (SELECT stratum, count(*) FILTER (WHERE arm = 'control') AS nc, count(*) FILTER (WHERE arm = 'treatment') AS nt, avg(m) FILTER (WHERE arm = 'control') AS c, avg(m) FILTER (WHERE arm = 'treatment') AS t FROM u GROUP BY 1) SELECT stratum, least(nc, nt) AS weight, round(1 - t / c, 6) AS reduction FROM s WHERE nc >= 3 AND nt >= 3")
def _(spark, d):
    from tessera.operators.stats import stratified_reduction

    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), "o_custkey", F.when(F.col("o_custkey") % 2 == 0, "control").otherwise("treatment").alias("arm"), "o_totalprice")
    return stratified_reduction(o, ["stratum"], "o_custkey", "arm", "o_totalprice").select("stratum", "weight", F.round("reduction", 6).alias("reduction"))


@query("g15_distribution", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(coalesce(stddev_samp(o_totalprice), 0), 3) AS sd FROM orders GROUP BY 1")
def _(spark, d):
    q = lambda p: F.round(F.percentile("o_totalprice", F.lit(p)), 4)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.round(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)), 3).alias("sd"))


@query("g16_recall", "WITH e AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS want, list_distinct(list(l_suppkey)) AS got FROM lineitem GROUP BY 1) SELECT l_orderkey, round(CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(want, got)) / len(want)::DOUBLE END, 6) AS recall FROM e")
def _(spark, d):
    from tessera.operators.evaluation import recall

    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("want"), F.collect_set("l_suppkey").alias("got"))
    return e.select("l_orderkey", F.round(recall(F.col("want"), F.col("got")), 6).alias("recall"))


@query("g21_budget_calibration", "SELECT l_suppkey, CAST(least(4000, greatest(1, ceil(quantile_cont(l_quantity, 0.9) * 1.15))) AS BIGINT) AS budget FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT l_orderkey) >= 3")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.9)).alias("p"), F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("k"))
    return g.where("n >= 3 and k >= 3").select("l_suppkey", F.least(F.lit(4000), F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * 1.15, 9)))).cast("long").alias("budget"))


@query("g22_gates", "SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS every, bool_or(o_orderstatus = 'P') AS any_bad, count(*) FILTER (WHERE o_totalprice > 200000) AS regressions, (count(*) >= 10 AND bool_and(o_orderstatus <> 'P')) AS accepted FROM orders GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("every"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_bad"), F.count_if(F.col("o_totalprice") > 200000).alias("regressions"), F.count("*").alias("n"))
    return g.select("o_custkey", "every", "any_bad", "regressions", ((F.col("n") >= 10) & F.col("every")).alias("accepted"))


@query("g27_duplicate_content", r"SELECT sha256(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    from tessera.functions.text import fingerprint

    return table(spark, d, "documents").groupBy(fingerprint(F.col("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("g28_store_stats", "SELECT count(*) AS n, coalesce(CAST(sum(strlen(text)) AS BIGINT), 0) AS bytes FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))


@query("g29_field_hints", "WITH f AS (SELECT event_type, props AS field, count(*) AS exposures, count(*) FILTER (WHERE value > 50) AS retrievals FROM events GROUP BY 1, 2), c AS (SELECT *, round(least(1.0, retrievals / exposures::DOUBLE), 6) AS confidence FROM f WHERE exposures >= 3 AND retrievals >= 2) SELECT event_type, field, confidence FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY confidence DESC, retrievals DESC, field) AS rk FROM c WHERE confidence >= 0.3) WHERE rk <= 16")
def _(spark, d):
    from tessera.operators.evaluation import field_hints

    e = table(spark, d, "events").select("event_type", F.col("props").alias("field"), (F.col("value") > 50).alias("hit"))
    return field_hints(e, "event_type", "field", "hit")


@query("g30_table_fingerprint", "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || m[1:11] AS BIGINT)::HUGEINT) AS VARCHAR) AS low, CAST(sum(CAST('0x' || m[12:22] AS BIGINT)::HUGEINT) AS VARCHAR) AS high FROM (SELECT md5(CAST(doc_id AS VARCHAR) || ':' || text) AS m FROM documents)")
def _(spark, d):
    from tessera.operators.evaluation import table_fingerprint

    return table_fingerprint(table(spark, d, "documents"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")))


@query("g31_document_frequency", "SELECT w AS term, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("term")).groupBy("term").agg(F.countDistinct("p_partkey").alias("df"))


@query("g32_top_k_values", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("g33_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


# ---- windows ---------------------------------------------------------------------------------------------------------


@query("w1_repeated_runs", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, min(event_id) AS first_id, event_type, count(*) AS n FROM e GROUP BY user_id, event_type, g HAVING count(*) >= 3")
def _(spark, d):
    from tessera.operators.sessions import runs

    return runs(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], 3, "event_id")


_CHURN = "t AS (SELECT user_id, event_id, CAST(value * 1000 AS BIGINT) AS created, CAST(event_id % 50000 AS BIGINT) AS rd, lag(CAST(value * 1000 AS BIGINT) + event_id % 50000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events)"


@query("w2_cache_churn", f"WITH {_CHURN}, k AS (SELECT *, CASE WHEN prior IS NULL THEN 'initial_observation' WHEN created = 0 THEN CASE WHEN rd > 0 THEN 'cache_hit' ELSE 'uncached' END WHEN rd >= prior THEN 'prefix_growth' WHEN created >= 20000 AND prior >= 20000 AND created + rd >= prior * 0.8 THEN 'suspected_recreation' ELSE 'unclassified_write' END AS kind FROM t) SELECT event_id, kind, CASE WHEN kind = 'suspected_recreation' THEN least(created, greatest(0, prior - rd)) ELSE 0 END AS recreated FROM k")
def _(spark, d):
    from tessera.operators.sessions import cache_churn

    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 1000).cast("long").alias("created"), (F.col("event_id") % 50000).alias("rd"))
    return cache_churn(e, ["user_id"], ["ts", "event_id"], "created", "rd").select("event_id", "kind", "recreated")


@query("w3_epochs", "SELECT event_id, CAST(sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.sum((F.col("event_type") == "signup").cast("int")).over(w).cast("long").alias("epoch"))


@query("w4_idle_gaps", "SELECT event_id, round(gap, 4) AS minutes FROM (SELECT event_id, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 60.0::DOUBLE AS gap FROM events) WHERE gap >= 5")
def _(spark, d):
    from tessera.operators.sessions import idle_gaps

    return idle_gaps(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", F.round("minutes", 4).alias("minutes"))


@query("w5_retries", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS rk FROM events) WHERE rk > 1")
def _(spark, d):
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("rk")).where("rk > 1").select("event_id")


@query("w6_waste_signals", "SELECT user_id, event_type, min(event_id) AS first_id FROM (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE event_type = 'error' AND n >= 3 GROUP BY 1, 2")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    e = table(spark, d, "events").withColumn("n", F.count_if(F.col("event_type") == "error").over(w))
    return e.where("event_type = 'error' and n >= 3").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("w7_repeat_outputs", "SELECT event_id FROM (SELECT event_id, md5(props) AS dg, lag(md5(props)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS pd FROM events) WHERE dg = pd")
def _(spark, d):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "props", F.lag("props").over(w).alias("before")).where("props = before").select("event_id")


@query("w8_history_dedup", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) > 1 AS pointer FROM conversations")
def _(spark, d):
    w = Window.partitionBy("conv_id", F.xxhash64("text"), "text").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) > 1).alias("pointer"))


@query("w9_ranks", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rank FROM documents")
def _(spark, d):
    from tessera.operators.graph import rank_by

    return rank_by(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"]).select("doc_id", "rank")


@query("w11_weighted_top3", "SELECT l_orderkey, round(sum(l_quantity * CASE rk WHEN 1 THEN 1.0 WHEN 2 THEN 0.35 ELSE 0.15 END), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rk FROM lineitem) WHERE rk <= 3 GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber").withColumn("rk", F.row_number().over(w)).where("rk <= 3")
    return r.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.when(F.col("rk") == 1, 1.0).when(F.col("rk") == 2, 0.35).otherwise(0.15)), 4).alias("score"))


@query("w13_head_errors_tail")
def _(spark, d):
    from tessera.operators.compaction import head_errors_tail

    return head_errors_tail(table(spark, d, "documents"), "doc_id", 20, 5).groupBy("doc_id", "part").agg(F.count("*").alias("n"))


@query("w16_fit_prefix", "SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000")
def _(spark, d):
    from tessera.operators.budget import fit_prefix

    return fit_prefix(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20000).select("doc_id", "source")


# every fourth request has its first message edited, so prefixes break and are taken up again
@query(
    "w17_prefix_reuse",
    """WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
 p AS (SELECT conv_id, turn, role, list('message:' || sha256(role || chr(10) || text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS p FROM m),
 c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN p[1:len(p) - 1] ELSE p END AS p FROM p),
 e AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 AND len(p) > 0 THEN list_concat(['edited'], p[2:]) ELSE p END AS p FROM c),
 l AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM e)
 SELECT conv_id, turn, CASE WHEN b IS NULL THEN 'miss' WHEN p = b THEN 'exact' WHEN len(b) > 0 AND p[1:len(b)] = b THEN 'extended' ELSE 'miss' END AS reuse FROM l""",
)
def _(spark, d):
    from tessera.operators.sessions import prefix_elements, prefix_reuse

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = table(spark, d, "conversations").withColumn("messages", F.collect_list(F.struct("role", "text")).over(w))
    e = prefix_elements(F.col("messages"))
    edited = F.when((F.col("turn") % 4 == 3) & (F.size(e) > 0), F.concat(F.array(F.lit("edited")), F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))))).otherwise(e)
    return prefix_reuse(seen.select("conv_id", "turn", edited.alias("elements")), "conv_id", "turn").select("conv_id", "turn", "reuse")


@query("w18_change_point", "SELECT user_id, round(avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-15'), 4) AS before, round(avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 4) AS after FROM events GROUP BY 1")
def _(spark, d):
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when(early, F.col("value"))), 4).alias("before"), F.round(F.avg(F.when(~early, F.col("value"))), 4).alias("after"))


# ---- top-k and sets --------------------------------------------------------------------------------------------------


@query("l1_biggest", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def _(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc_nulls_last("value"), "event_id").limit(25)


@query("l6_recent", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, d):
    from tessera.sources.events import newest

    return newest(table(spark, d, "events").where("event_type = 'view'"), 50, ["ts", "event_id"]).select("event_id")


@query("l7_select_items", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def _(spark, d):
    best = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc("o_totalprice"), "o_orderkey")
    kept = table(spark, d, "orders").withColumn("rk", F.row_number().over(best)).where("rk <= 3")
    return kept.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("position"))


@query("u1_ordered_distinct", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("u2_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").select("o_custkey").distinct()).distinct()


@query("u4_union_precedence", "SELECT k, kind FROM (SELECT k, kind, row_number() OVER (PARTITION BY k ORDER BY p) AS rk FROM (SELECT s_nationkey AS k, 'supplier' AS kind, 1 AS p FROM supplier UNION ALL SELECT c_custkey % 25, 'customer', 2 FROM customer)) WHERE rk = 1")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind"), F.lit(1).alias("p"))
    b = table(spark, d, "customer").select((F.col("c_custkey") % 25).alias("k"), F.lit("customer").alias("kind"), F.lit(2).alias("p"))
    return a.unionByName(b).groupBy("k").agg(F.min_by("kind", "p").alias("kind"))


@query("u5_strict_superset", "WITH s AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS a FROM orders GROUP BY 1) SELECT o_custkey, len(list_filter(['F'], lambda x: NOT list_contains(a, x))) = 0 AND len(a) > 1 AS superset FROM s")
def _(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"))
    return s.select("o_custkey", ((F.size(F.array_except(F.array(F.lit("F")), "a")) == 0) & (F.size("a") > 1)).alias("superset"))


@query("u6_merge_shards", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders")
    parts = [o.where(F.col("o_orderkey") % 3 == i).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
