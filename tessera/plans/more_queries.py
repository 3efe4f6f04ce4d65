"""Queries of paths, payloads, evaluation, calibration, planning and the remaining statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query, table

_DIRS = ["src/", "node_modules/x/", "tests/", "../", "./", "migrations/", "lib/a/", "scripts/b/"]
_NAMES = ["main.py", "test_a.py", ".env", "server.key", "util.ts", "id_rsa", ".npmrc", ".env.dist", "release.keystore"]
_PATH_SQL = f"({_DIRS}[CAST(p_partkey % {len(_DIRS)} AS INT) + 1] || {_NAMES}[CAST(p_size % {len(_NAMES)} AS INT) + 1])"


def _paths(spark, d):
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (c % len(xs)).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(pick(_DIRS, F.col("p_partkey")), pick(_NAMES, F.col("p_size"))).alias("path"))


@query("s3_path_decision", f"SELECT p_partkey, CASE WHEN path LIKE '../%' THEN 'outside-root' WHEN path LIKE 'node_modules/%' THEN 'generated-or-vendor' WHEN path LIKE '%.env' OR path LIKE '%.key' OR path LIKE '%id_rsa' OR path LIKE '%.npmrc' OR path LIKE '%.keystore' THEN 'sensitive-path' ELSE 'allowed' END AS decision FROM (SELECT p_partkey, {_PATH_SQL} AS path FROM part)")
def _(spark, d):
    from tessera.functions.payloads import path_decision

    return _paths(spark, d).select("p_partkey", path_decision(F.col("path")).alias("decision"))


@query("t23_file_priority", f"SELECT p_partkey, CASE WHEN path LIKE 'tests/%' OR path LIKE 'migrations/%' OR path LIKE 'scripts/%' OR path LIKE '%test_a.py' THEN 3 WHEN path LIKE '%main.py' THEN 0 WHEN path LIKE 'src/%' OR path LIKE 'lib/%' OR path LIKE './%' THEN 1 ELSE 2 END AS tier FROM (SELECT p_partkey, {_PATH_SQL} AS path FROM part)")
def _(spark, d):
    from tessera.functions.payloads import file_priority

    return _paths(spark, d).select("p_partkey", file_priority(F.col("path")).alias("tier"))


_REDACTED_SQL = r"""trim(regexp_replace(text, '\s+', ' ', 'g'))"""
for _rx, _to in (
    (r"(?i)((?:password|passwd|token|secret|api[_-]?key)\s*[=:]\s*)(\S+)", r"\1<redacted>"), (r"(?i)(--(?:password|passwd|token|secret|api[-_]?key|authorization)\s+)(\S+)", r"\1<redacted>"),
    (r"(?i)(authorization\s*:\s*(?:bearer\s+)?)(\S+)", r"\1<redacted>"), (r"(https?://[^:/\s]+:)[^@/\s]+@", r"\1<redacted>@"),
):
    _REDACTED_SQL = f"regexp_replace({_REDACTED_SQL}, '{_rx}', '{_to}', 'g')"


# commands with each form of secret around the whole texts of documents
@query("t12_redact_command", f"SELECT doc_id, md5(({_REDACTED_SQL})[1:320]) AS md5 FROM (SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'run --token  abc def ' WHEN 1 THEN 'curl https://me:pw@host/x ' WHEN 2 THEN 'Authorization: Bearer xyz  API_KEY = q1 ' ELSE '' END || text AS text FROM documents)")
def _(spark, d):
    from tessera.functions.payloads import redact_command

    ahead = F.when(F.col("doc_id") % 4 == 0, "run --token  abc def ").when(F.col("doc_id") % 4 == 1, "curl https://me:pw@host/x ").when(F.col("doc_id") % 4 == 2, "Authorization: Bearer xyz  API_KEY = q1 ").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.md5(redact_command(F.concat(ahead, "text")).cast("binary")).alias("md5"))


#: Heads that, put before every tenth text, bring in each kind of payload.
_HEADS = ["", "diff --git a/x b/x\n@@ -1 +1 @@\n", "|a|b|\n" * 40, "a,b\n1,2\n3,4\n5,6", "2024-01-02 INFO started\n", "a.py:1: x\na.py:2: y\nb.py:3: z\n", "def a():\nclass B:\nimport c\n", "[section]\nkey = 1\n", "a;b\tc\n", "a: 1\n"]


def _kind_sql(table_sql: str) -> str:
    from tessera.functions import payloads as P

    q = lambda rx: rx.replace("'", "''")
    hits = lambda n, rx: f"len(list_filter(f[1:{n}], lambda x: regexp_matches(x, '{q(rx)}')))"
    w = lambda m: f"list_transform(f[1:80], lambda x: length(regexp_replace(x, '\"[^\"]*\"', '', 'g')) - length(replace(regexp_replace(x, '\"[^\"]*\"', '', 'g'), {m}, '')))"
    delimited = " OR ".join(f"(len(f) >= 4 AND list_min({w(m)}) >= 1 AND list_min({w(m)}) = list_max({w(m)}))" for m in ("','", "chr(9)", "';'"))
    return f"""SELECT id, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^[\\[{{]') AND json_valid(t) THEN 'json' WHEN regexp_matches(text, '{q(P.DIFF_HEAD)}') AND contains(text, '@@') THEN 'diff'
 WHEN regexp_matches(text, '{q(P.HTML_TAG)}') THEN 'html' WHEN len(f) >= 4 AND len(list_filter(f[1:100], lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= greatest(3, floor(least(len(f), 100) * 0.7::DOUBLE)) THEN 'markdown-table'
 WHEN {delimited} THEN 'delimited-table' WHEN regexp_matches(text, '{q(P.LOG_LINE)}') THEN 'log' WHEN {hits(40, P.SEARCH_LINE)} >= 3 THEN 'search-results'
 WHEN {hits(160, P.SOURCE_LINE)} >= 3 AND NOT regexp_matches(text, '{q(P.DIAGNOSTIC)}') THEN 'source' WHEN regexp_matches(text, '{q(P.INI_LINE)}') OR regexp_matches(text, '{q(P.YAML_LINE)}') THEN 'configuration' ELSE 'text' END AS kind
 FROM (SELECT id, text, regexp_replace(text, '^\\s+', '') AS t, list_filter(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\\S')) AS f FROM ({table_sql}))"""


_HEADS_SQL = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for h in _HEADS) + "]"


@query("t26_t27_content_kind", _kind_sql(f"SELECT 'p' || page_id AS id, html AS text FROM pages UNION ALL SELECT 'e' || event_id, props FROM events UNION ALL SELECT 'd' || doc_id, {_HEADS_SQL}[CAST(doc_id % 10 AS INT) + 1] || text FROM documents UNION ALL SELECT 'h' || c_custkey, {_HEADS_SQL}[CAST(c_custkey % 10 AS INT) + 1] FROM customer"))
def _(spark, d):
    from tessera.functions.payloads import content_kind

    head = lambda c: F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col(c) % len(_HEADS)).cast("int"))
    own = lambda name, mark, key, text: table(spark, d, name).select(F.concat(F.lit(mark), key).alias("id"), text.alias("text"))
    texts = own("pages", "p", "page_id", F.col("html")).union(own("events", "e", "event_id", F.col("props")))
    texts = texts.union(own("documents", "d", "doc_id", F.concat(head("doc_id"), F.col("text")))).union(own("customer", "h", "c_custkey", head("c_custkey")))
    return texts.select("id", content_kind(F.col("text")).alias("kind"))


@query("t31_path_overlap", "SELECT p_partkey, len(list_intersect(list_distinct(string_split(lower(p_type), ' ')), ['steel', 'large', 'small'])) AS overlap FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(F.split(F.lower("p_type"), " "), F.array(F.lit("steel"), F.lit("large"), F.lit("small")))).cast("long").alias("overlap"))


@query("s12_field_upsert", "SELECT event_type, props AS field, count(*) AS exposures, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.col("props").alias("field")).agg(F.count("*").alias("exposures"), F.max("ts").alias("last_seen"))


@query("s18_duplicate_runs", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@query("s19_alias_rates", "SELECT DISTINCT unnest([p_brand, lower(p_brand)]) AS model, p_brand AS canonical FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("canonical")).distinct().select(F.explode(F.array("canonical", F.lower("canonical"))).alias("model"), "canonical").distinct()


@query("s25_prometheus", "SELECT 'calls_total{type=\"' || event_type || '\"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type")
def _(spark, d):
    from tessera.functions.payloads import prometheus

    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select(prometheus("calls_total", {"type": F.col("event_type")}, F.col("n")).alias("line"))


@query("a10_named_rows", "SELECT n_nationkey, 'n_name' AS field, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def _(spark, d):
    named = F.map_from_arrays(F.array(F.lit("n_name"), F.lit("n_regionkey")), F.array("n_name", F.col("n_regionkey").cast("string")))
    return table(spark, d, "nation").select("n_nationkey", F.explode(named).alias("field", "v"))


@query("f1_candidates", "SELECT doc_id FROM documents WHERE strlen(text) <= 4000 AND source NOT IN ('src1', 'src2')")
def _(spark, d):
    return table(spark, d, "documents").where((F.octet_length("text") <= 4000) & ~F.col("source").isin("src1", "src2")).select("doc_id")


@query("f8_candidate_invariants", r"SELECT doc_id, length(s) < length(text) AS smaller, regexp_matches(s, '\n') = regexp_matches(text, '\n') AS lines_kept FROM (SELECT doc_id, text, regexp_replace(text, ' +', ' ', 'g') AS s FROM documents)")
def _(spark, d):
    own = table(spark, d, "documents").withColumn("s", F.regexp_replace("text", " +", " "))
    return own.select("doc_id", (F.length("s") < F.length("text")).alias("smaller"), (F.contains("s", F.lit("\n")) == F.contains("text", F.lit("\n"))).alias("lines_kept"))


def _eligible(spark, d, condition: str = "true"):
    """Each order with the brands whose largest part is large enough for it; by default all orders."""
    caps = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("cap"))
    return table(spark, d, "orders").where(condition).join(caps, F.expr("cap >= o_custkey % 60")).select("o_orderkey", "p_brand")


@query("f10_eligible", "SELECT o_orderkey, p_brand FROM orders JOIN (SELECT p_brand, max(p_size) AS cap FROM part GROUP BY 1) m ON m.cap >= o_custkey % 60 WHERE o_orderkey % 20 = 0")  # every 20th order, as its SQL asks
def _(spark, d):
    return _eligible(spark, d, "o_orderkey % 20 = 0")


@query("f10_eligible_all")
def _(spark, d):
    return _eligible(spark, d)


@query("j5_index_probe", "SELECT p_partkey, count(*) AS hits FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w IN ('STEEL', 'SMALL', 'BRUSHED') GROUP BY 1")
def _(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("w"))
    asked = spark.createDataFrame([("STEEL",), ("SMALL",), ("BRUSHED",)], "w string")
    return words.join(F.broadcast(asked), "w").groupBy("p_partkey").agg(F.count("*").alias("hits"))


@query("g8_routing_summary", "SELECT o_orderpriority AS target, count(*) AS decisions, count(*) FILTER (WHERE o_orderstatus = 'F') AS matched, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS rate FROM orders GROUP BY 1")
def _(spark, d):
    m = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("target")).agg(F.count("*").alias("decisions"), m.alias("matched"), F.round(m / F.count("*"), 6).alias("rate"))


@query("g9_savings", "SELECT event_type, user_id, round(sum(value), 4) AS saved, grouping(user_id) AS overall FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id))")
def _(spark, d):
    e = table(spark, d, "events")
    e.createOrReplaceTempView("tessera_g9_events")
    return spark.sql("SELECT event_type, user_id, round(sum(value), 4) AS saved, CAST(grouping(user_id) AS BIGINT) AS overall FROM tessera_g9_events GROUP BY GROUPING SETS ((event_type), (event_type, user_id))")


@query("g11_token_cost", "SELECT role, CAST(sum(greatest(1, CAST(floor(length(text) / 3.5::DOUBLE) AS BIGINT))) AS BIGINT) AS tokens, count(*) AS calls FROM conversations WHERE text <> '' GROUP BY 1")
def _(spark, d):
    from tessera.functions.text import estimate_tokens

    return table(spark, d, "conversations").where("text <> ''").groupBy("role").agg(F.sum(estimate_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("calls"))


@query("g17_arm_recall", "WITH r AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS want, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'N') AS lex, count(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS sem FROM lineitem GROUP BY 1) SELECT count(*) AS tasks, round(avg(lex / want::DOUBLE), 6) AS lexical, round(avg(sem / want::DOUBLE), 6) AS semantic, count(*) FILTER (WHERE sem > lex) AS improved, count(*) FILTER (WHERE sem < lex) AS worsened FROM r")
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("want"), F.countDistinct(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("lex"), F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("sem"))
    return r.agg(F.count("*").alias("tasks"), F.round(F.avg(F.col("lex") / F.col("want")), 6).alias("lexical"), F.round(F.avg(F.col("sem") / F.col("want")), 6).alias("semantic"), F.count_if(F.col("sem") > F.col("lex")).alias("improved"), F.count_if(F.col("sem") < F.col("lex")).alias("worsened"))


@query("g19_stage_activity", "SELECT stage, round(sum(delta), 4) AS net, round(sum(abs(delta)), 4) AS moved, round(max(abs(delta)), 4) AS largest, count(DISTINCT l_orderkey) FILTER (WHERE delta <> 0) AS changed FROM (SELECT l_orderkey, unnest(['discount', 'tax']) AS stage, unnest([-l_discount * l_extendedprice, l_tax * l_extendedprice]) AS delta FROM lineitem) GROUP BY 1")
def _(spark, d):
    each = F.array(F.struct(F.lit("discount").alias("stage"), (-F.col("l_discount") * F.col("l_extendedprice")).alias("delta")), F.struct(F.lit("tax").alias("stage"), (F.col("l_tax") * F.col("l_extendedprice")).alias("delta")))
    x = table(spark, d, "lineitem").select("l_orderkey", F.inline(each))
    return x.groupBy("stage").agg(F.round(F.sum("delta"), 4).alias("net"), F.round(F.sum(F.abs("delta")), 4).alias("moved"), F.round(F.max(F.abs("delta")), 4).alias("largest"), F.countDistinct(F.when(F.col("delta") != 0, F.col("l_orderkey"))).alias("changed"))


@query("g20_rank_drop", "SELECT o_orderpriority, quantile_disc(o_custkey % 50, 0.5) AS p50, quantile_disc(o_custkey % 50, 0.95) AS p95, max(o_custkey % 50) AS worst, count(*) >= 20 AS ready FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("x", F.col("o_custkey") % 50)
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").cast("long")
    return o.groupBy("o_orderpriority").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("x").alias("worst"), (F.count("*") >= 20).alias("ready"))


@query("g24_event_counters", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS large FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("large"))


@query("g25_runtime_activation", "SELECT round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS total, count(DISTINCT user_id) FILTER (WHERE event_type = 'view' AND value > 0) AS active, bool_and(value IS NOT NULL) FILTER (WHERE event_type = 'view') AS complete FROM events")
def _(spark, d):
    v = table(spark, d, "events").where("event_type = 'view'")
    return v.agg(F.round(F.sum("value"), 4).alias("total"), F.countDistinct(F.when(F.col("value") > 0, F.col("user_id"))).alias("active"), F.bool_and(F.col("value").isNotNull()).alias("complete"))


@query("g26_coverage", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 150000) AS selected, count(*) FILTER (WHERE o_totalprice > 150000) = 0 AS missing FROM orders GROUP BY 1")
def _(spark, d):
    s = F.count_if(F.col("o_totalprice") > 150000)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), s.alias("selected"), (s == 0).alias("missing"))


def _most_overlap(spark, d, condition: str = "true"):
    """The five documents with the most words of each benchmark item; by default of all items."""
    q = table(spark, d, "benchmark").where(condition).select("item_id", F.explode(F.split("text", " ")).alias("w")).select("item_id", F.lower("w").alias("w")).distinct()
    texts = table(spark, d, "documents").select("doc_id", "text")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    # dealt by document first: a task holds the pairs of its own documents, and they are counted where they are
    docs = texts.repartition(n, "doc_id").select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", " "), F.lower))).alias("w"))
    s = docs.join(q, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")
    return s.withColumn("rk", F.row_number().over(w)).where("rk <= 5").select("item_id", "doc_id", "overlap")


@query("g18_trivial_baseline", "WITH q AS (SELECT DISTINCT item_id, lower(unnest(string_split(text, ' '))) AS w FROM benchmark WHERE item_id % 50 = 0), dw AS (SELECT DISTINCT doc_id, lower(unnest(string_split(text, ' '))) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN dw ON q.w = dw.w GROUP BY 1, 2) SELECT item_id, doc_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rk FROM s) WHERE rk <= 5")  # the stated query set
def _(spark, d):
    return _most_overlap(spark, d, "item_id % 50 = 0")


@query("g18_trivial_baseline_all")
def _(spark, d):
    return _most_overlap(spark, d)


@query("w15_context_omission", "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag = 'R' AS changed FROM lineitem), m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - row_number() OVER (PARTITION BY l_orderkey, changed ORDER BY l_linenumber, l_partkey, l_extendedprice) AS g FROM l) SELECT l_orderkey, min(l_linenumber) AS first_line, count(*) AS omitted FROM m WHERE NOT changed GROUP BY l_orderkey, g HAVING count(*) >= 2")
def _(spark, d):
    order = ("l_linenumber", "l_partkey", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    v = Window.partitionBy("l_orderkey", "changed").orderBy(*order)
    li = table(spark, d, "lineitem").select("l_orderkey", *order, (F.col("l_returnflag") == "R").alias("changed"))
    m = li.withColumn("g", F.row_number().over(w) - F.row_number().over(v)).where("not changed")
    return m.groupBy("l_orderkey", "g").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("omitted")).where("omitted >= 2").drop("g")


@query("l4_hit_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc_id, i, len(list_intersect(list_distinct(string_split(lower(line), ' ')), ['the', 'and', 'of', 'die', 'la'])) AS hits FROM l) SELECT doc_id, i - 1 AS line_no, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS rk FROM s WHERE hits > 0) WHERE rk <= 4")
def _(spark, d):
    asked = F.array(*[F.lit(x) for x in ("the", "and", "of", "die", "la")])
    scored = F.transform(F.split("text", "\n"), lambda x, i: F.struct((-F.size(F.array_intersect(F.split(F.lower(x), " "), asked))).alias("s"), i.alias("i")))
    best = F.slice(F.array_sort(F.filter(scored, lambda r: r["s"] < 0)), 1, 4)  # within each text: no shuffle
    return table(spark, d, "documents").select("doc_id", F.inline(best)).select("doc_id", F.col("i").cast("long").alias("line_no"), (-F.col("s")).cast("long").alias("hits"))


@query("l8_search_results", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, min(event_id)) AS rk FROM events GROUP BY 1, 2) WHERE rk <= 3")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    w = Window.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "error"), "first_id")
    return g.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("user_id", "event_type")


@query("gr5_symbol_tiers", "WITH m AS (SELECT p_partkey, CASE WHEN lower(p_name) = 'part 1' THEN 1 WHEN lower(p_name) LIKE '%1%' THEN 2 END AS tier FROM part) SELECT p_partkey FROM m WHERE tier = (SELECT min(tier) FROM m)")
def _(spark, d):
    n = F.lower("p_name")
    m = table(spark, d, "part").select("p_partkey", F.when(n == "part 1", 1).when(n.contains("1"), 2).alias("tier")).where("tier is not null")
    return m.join(F.broadcast(m.agg(F.min("tier").alias("tier"))), "tier").select("p_partkey")


@query("b4_retrieval_plan", "SELECT o_orderkey, CASE WHEN b < 100000 THEN 4 WHEN b < 200000 THEN 8 ELSE 12 END AS seeds, CASE WHEN b < 100000 THEN 1 ELSE 2 END AS hops FROM (SELECT o_orderkey, o_totalprice AS b FROM orders)")
def _(spark, d):
    b = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(b < 100000, 4).when(b < 200000, 8).otherwise(12).alias("seeds"), F.when(b < 100000, 1).otherwise(2).alias("hops"))


_B6_NAMES = ["source", "history", "memory", "tool_results", "schemas", "reserve"]


@query(
    "b6_context_budget",
    f"""WITH b(task, ws) AS (VALUES ('general', [0.50::DOUBLE, 0.15, 0.08, 0.10, 0.06, 0.11]), ('coding', [0.60::DOUBLE, 0.10, 0.06, 0.10, 0.05, 0.09]), ('debugging', [0.50::DOUBLE, 0.12, 0.05, 0.20, 0.04, 0.09])),
 c AS (SELECT o_orderkey, 1000 + o_custkey AS total, ['general', 'coding', 'debugging'][CAST(o_orderkey % 3 AS INT) + 1] AS task, ['simple', 'complex', 'extended'][CAST(o_custkey % 3 AS INT) + 1] AS tier, o_orderstatus = 'F' AS risk,
  CASE WHEN o_custkey % 2 = 0 THEN o_custkey // 20 END AS want_history, CASE WHEN o_custkey % 5 = 0 THEN o_custkey // 3 END AS want_source, 40 AS want_tools FROM orders),
 w AS (SELECT c.*, unnest({_B6_NAMES}) AS name, unnest(ws) AS w FROM c JOIN b USING (task)),
 m AS (SELECT *, w * CASE name WHEN 'source' THEN (CASE tier WHEN 'complex' THEN 1.10::DOUBLE WHEN 'extended' THEN 1.18 ELSE 1.0 END) * (CASE WHEN risk THEN 1.08::DOUBLE ELSE 1.0 END) WHEN 'history' THEN (CASE WHEN tier = 'simple' THEN 1.0::DOUBLE ELSE 1.06 END)
  WHEN 'schemas' THEN (CASE WHEN tier = 'simple' THEN 1.0::DOUBLE ELSE 0.94 END) WHEN 'reserve' THEN (CASE WHEN risk THEN 1.20::DOUBLE ELSE 1.0 END) WHEN 'memory' THEN (CASE WHEN risk THEN 0.92::DOUBLE ELSE 1.0 END) ELSE 1.0 END AS mw FROM w),
 r AS (SELECT *, total * (mw / sum(mw) OVER (PARTITION BY o_orderkey)) AS raw FROM m),
 f AS (SELECT *, floor(raw) AS fl, total - sum(floor(raw)) OVER (PARTITION BY o_orderkey) AS lft, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(raw - floor(raw), 9) DESC, name DESC) AS rk FROM r),
 g AS (SELECT *, CAST(fl + (rk <= lft)::INT AS BIGINT) AS n, CASE name WHEN 'history' THEN want_history WHEN 'source' THEN want_source WHEN 'tool_results' THEN want_tools END AS want FROM f),
 k AS (SELECT *, coalesce(least(n, want), n) AS cut FROM g), s AS (SELECT *, sum(n - cut) OVER (PARTITION BY o_orderkey) AS freed, max(cut) FILTER (name = 'source') OVER (PARTITION BY o_orderkey) AS src FROM k),
 t AS (SELECT *, CASE WHEN want_source IS NULL THEN freed ELSE least(freed, greatest(0, want_source - src)) END AS ts FROM s)
 SELECT o_orderkey, name, CAST(cut + CASE name WHEN 'source' THEN ts WHEN 'reserve' THEN freed - ts ELSE 0 END AS BIGINT) AS tokens FROM t""",
)
def _(spark, d):
    from tessera.operators.budget import context_budget

    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs)).cast("int"))
    third = lambda n: F.floor(F.col("o_custkey") / n)
    seen = {"history": F.when(F.col("o_custkey") % 2 == 0, third(20)), "source": F.when(F.col("o_custkey") % 5 == 0, third(3)), "tool_results": F.lit(40)}
    plan = context_budget(1000 + F.col("o_custkey"), pick(["general", "coding", "debugging"], "o_orderkey"), pick(["simple", "complex", "extended"], "o_custkey"), F.col("o_orderstatus") == "F", seen)
    own = table(spark, d, "orders").select("o_orderkey", plan.alias("p"))
    return own.select("o_orderkey", F.explode(F.create_map(*[x for c in _B6_NAMES for x in (F.lit(c), F.col(f"p.{c}"))])).alias("name", "tokens"))


@query("b7_output_budget", "SELECT o_orderkey, CAST(greatest(250, least(2200, floor(o_custkey * (CASE o_orderstatus WHEN 'F' THEN 0.7::DOUBLE WHEN 'O' THEN 1.25 ELSE 1.5 END)))) AS BIGINT) AS budget FROM orders")
def _(spark, d):
    from tessera.operators.budget import clamp

    m = F.when(F.col("o_orderstatus") == "F", 0.7).when(F.col("o_orderstatus") == "O", 1.25).otherwise(1.5)
    return table(spark, d, "orders").select("o_orderkey", clamp(F.floor(F.col("o_custkey") * m), 250, 2200).cast("long").alias("budget"))


@query("b9_cache_break_even", "SELECT o_orderkey, CAST(ceil(round((1.25 - 1) / (1 - CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 0.10::DOUBLE WHEN 1 THEN 0.50 ELSE 0.25 END), 9)) AS BIGINT) AS reads FROM orders")
def _(spark, d):
    read = F.when(F.col("o_orderkey") % 3 == 0, 0.10).when(F.col("o_orderkey") % 3 == 1, 0.50).otherwise(0.25)
    return table(spark, d, "orders").select("o_orderkey", F.ceil(F.round((1.25 - 1) / (1 - read), 9)).cast("long").alias("reads"))


@query("b11_baseline_model", "SELECT l_returnflag, l_shipdate FROM (SELECT l_returnflag, l_shipdate, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_extendedprice), l_shipdate) AS rk FROM lineitem GROUP BY 1, 2) WHERE rk = 1")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.sum("l_extendedprice").alias("cost"))
    return g.groupBy("l_returnflag").agg(F.min(F.struct("cost", "l_shipdate")).alias("b")).select("l_returnflag", F.col("b.l_shipdate").alias("l_shipdate"))


@query("b13_grade", "WITH s AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY 1) SELECT user_id, round((coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0)) / ((a IS NOT NULL)::INT * 0.6::DOUBLE + (b IS NOT NULL)::INT * 0.4::DOUBLE), 4) AS score FROM s WHERE a IS NOT NULL")
def _(spark, d):
    side = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    s = table(spark, d, "events").groupBy("user_id").agg(side("view").alias("a"), side("error").alias("b")).where("a is not null")
    total = F.coalesce(F.col("a") * 0.6, F.lit(0.0)) + F.coalesce(F.col("b") * 0.4, F.lit(0.0))
    weight = F.col("a").isNotNull().cast("int") * 0.6 + F.col("b").isNotNull().cast("int") * 0.4
    return s.select("user_id", F.round(total / weight, 4).alias("score"))


@query("b14_tool_groups", "SELECT p_brand FROM (SELECT p_brand, count(*) FILTER (WHERE p_type LIKE '%STEEL%') AS hits FROM part GROUP BY 1) WHERE hits > 0 ORDER BY hits DESC, p_brand LIMIT 5")
def _(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_type").contains("STEEL")).alias("hits")).where("hits > 0")
    return g.orderBy(F.desc("hits"), "p_brand").limit(5).select("p_brand")


@query("b15_keep_or_revert", "SELECT user_id, CASE WHEN avg(value) FILTER (WHERE event_id % 2 = 1) < avg(value) FILTER (WHERE event_id % 2 = 0) THEN 'keep' ELSE 'revert' END AS verdict FROM events GROUP BY 1")
def _(spark, d):
    side = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(F.when(side(1) < side(0), "keep").otherwise("revert").alias("verdict"))


@query("k9_working_set", "SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "props")).alias("m"))
    return g.select("user_id", F.col("m.props").alias("props"))


@query("k13_pair_identity", "SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS status_differs, count(DISTINCT o_orderpriority) > 1 AS priority_differs FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.min("o_orderstatus") != F.max("o_orderstatus")).alias("status_differs"), (F.min("o_orderpriority") != F.max("o_orderpriority")).alias("priority_differs"))
    return g.where("n > 1").drop("n")


@query("x9_publication_gate", "SELECT o_orderpriority, count(DISTINCT o_custkey) >= 20 AS enough_tasks, count(*) / count(DISTINCT o_custkey)::DOUBLE >= 3 AS enough_trials FROM orders GROUP BY 1")
def _(spark, d):
    k = F.countDistinct("o_custkey")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg((k >= 20).alias("enough_tasks"), (F.count("*") / k >= 3).alias("enough_trials"))


@query("x10_agent_pairs", "WITH p AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS b, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS o FROM orders GROUP BY 1) SELECT count(*) AS pairs, round(avg(o - b), 3) AS mean, round(quantile_cont(o - b, 0.5), 3) AS median, round(stddev_samp(o - b), 2) AS sd, count(*) FILTER (WHERE o < b) AS improved FROM p WHERE b IS NOT NULL AND o IS NOT NULL")
def _(spark, d):
    from tessera.operators.stats import paired

    p = paired(table(spark, d, "orders").withColumn("arm", (F.col("o_orderkey") % 2).cast("string")).groupBy("o_custkey", "arm").agg(F.avg("o_totalprice").alias("v")), ["o_custkey"], "arm", "0", "1", "v")
    x = p.withColumn("delta", F.col("other") - F.col("base"))
    return x.agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 3).alias("mean"), F.round(F.percentile("delta", F.lit(0.5)), 3).alias("median"), F.round(F.stddev_samp("delta"), 2).alias("sd"), F.count_if(F.col("delta") < 0).alias("improved"))


@query("x12_freeze_hashes", "SELECT item_id, sha256('{\"id\":' || CAST(item_id AS VARCHAR) || ',\"n\":' || CAST(length(text) AS VARCHAR) || '}') AS frozen FROM benchmark")
def _(spark, d):
    j = F.to_json(F.struct(F.col("item_id").alias("id"), F.length("text").alias("n")))
    return table(spark, d, "benchmark").select("item_id", F.sha2(j, 256).alias("frozen"))


@query("st4_ttl_state", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE event_type = 'view'")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").where("event_type = 'view'").select("event_id", F.lag("event_id").over(w).alias("previous"))


@query("st6_usage_max", "SELECT user_id, max(value) AS value FROM events GROUP BY 1")
def _(spark, d):
    from tessera.streaming.windows import running_max

    return running_max(table(spark, d, "events"), "user_id", ["value"])


# many more ups than downs, so that counters saturate
@query("st8_feedback", "SELECT user_id, CAST(list_reduce(list_concat([0], list(CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 1 WHEN event_type = 'error' THEN -3 ELSE 0 END ORDER BY ts, event_id)), lambda a, b: greatest(-10, least(10, a + b))) AS BIGINT) AS value FROM events GROUP BY 1")
def _(spark, d):
    from tessera.streaming.state import bounded_counter

    e = table(spark, d, "events").withColumn("delta", F.when(F.col("event_type").isin("purchase", "view", "click"), 1).when(F.col("event_type") == "error", -3).otherwise(0))
    return bounded_counter(e, "user_id", "delta", ["ts", "event_id"], bucket=F.to_date("ts"))


@query("st10_sliding", "SELECT start_at, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS start_at FROM events) GROUP BY 1, 2")
def _(spark, d):
    from tessera.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 hour", "30 minutes").select("start_at", "event_type", "n")
