"""Queries of the scalar text, array and predicate functions, over documents, conversations, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.registry import query, table
from tessera.sources.tables import spread

_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_RAW_SQL = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace(translate(text, '_-/', '   '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z][A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Za-z0-9_$]+'), lambda w: regexp_replace(lower(w), '^[_$]+|[_$]+$', '', 'g'))"""
_STEM_SQL = """CASE WHEN t LIKE '%ize' AND length(t) > 6 THEN t[:-4]
 WHEN t LIKE '%ing' AND length(t) > 6 THEN (CASE WHEN length(t) > 5 AND t[-4:-4] = t[-5:-5] THEN t[:-5] ELSE t[:-4] END) || (CASE WHEN (CASE WHEN length(t) > 5 AND t[-4:-4] = t[-5:-5] THEN t[:-5] ELSE t[:-4] END)[-1:] = 'c' THEN 'e' ELSE '' END)
 WHEN t LIKE '%ed' AND length(t) > 5 THEN t[:-3] || (CASE WHEN t[-3:-3] IN ('s', 'g', 'c', 'v') THEN 'e' ELSE '' END)
 WHEN t LIKE '%s' AND length(t) > 4 THEN t[:-2] END"""
TERMS_SQL = f"""flatten(list_transform(list_filter({_RAW_SQL}, lambda t: length(t) >= 2 AND t NOT IN ({_STOP_SQL})),
 lambda t: list_filter([t, CASE WHEN t IN ('outline', 'structural') THEN 'skeleton' END, {_STEM_SQL}], lambda x: x IS NOT NULL)))"""


def _docs(spark, d):
    return table(spark, d, "documents")


@query("t1_terms", f"SELECT doc_id, len(ts) AS n_terms, md5(array_to_string(ts, ' ')) AS terms_md5 FROM (SELECT doc_id, {TERMS_SQL} AS ts FROM documents)")
def _(spark, d):
    return spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", X.terms(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.md5(F.array_join("ts", " ").cast("binary")).alias("terms_md5"))


@query("t2_identifier_terms", f"SELECT doc_id, len(ts) AS n_terms, md5(array_to_string(ts, ' ')) AS terms_md5 FROM (SELECT doc_id, list_filter({_RAW_SQL}, lambda t: length(t) >= 2) AS ts FROM documents)")
def _(spark, d):
    return spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", X.identifier_terms(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.md5(F.array_join("ts", " ").cast("binary")).alias("terms_md5"))


@query(
    "t4_document_counts",
    f"""WITH w AS (SELECT doc_id, unnest({TERMS_SQL}) AS term, 1 AS weight FROM documents
 UNION ALL SELECT doc_id, unnest({TERMS_SQL.replace('translate(text,', "translate(split_part(text, chr(10), 1),")}), 2 FROM documents
 UNION ALL SELECT doc_id, unnest({TERMS_SQL.replace('translate(text,', 'translate(source,')}), 3 FROM documents)
 SELECT doc_id, term, CAST(sum(weight) AS BIGINT) AS tf FROM w GROUP BY doc_id, term""",
)
def _(spark, d):
    from tessera.operators.ranking import document_counts

    return document_counts(spread(_docs(spark, d).select("doc_id", "text", "source")), {"text": 1, "outline": 2, "source": 3}, outline=True)


@query("t5_identifier_tokens", r"SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS md5 FROM (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: length(t) > 2), lambda t: lower(t)))) AS ts FROM documents)")
def _(spark, d):
    return spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", X.identifier_tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ").cast("binary")).alias("md5"))


@query("t6_char_ngrams", "SELECT DISTINCT p_brand, array_to_string(list_transform(range(1, length(p_brand) + 1), lambda i: ('^' || p_brand || '$')[i:i+2]), '|') AS grams FROM part WHERE length(p_brand) > 0")
def _(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.array_join(X.char_ngrams(F.col("p_brand")), "|").alias("grams"))


@query("t7_estimate_tokens", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.5::DOUBLE) AS BIGINT)) END AS prose, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / (CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 3.1::DOUBLE WHEN 1 THEN 2.4::DOUBLE ELSE 3.3::DOUBLE END)) AS BIGINT)) END AS by_path FROM documents")
def _(spark, d):
    path = F.concat(F.col("source"), F.element_at(F.array(F.lit(".py"), F.lit(".json"), F.lit(".xyz")), (F.col("doc_id") % 3 + 1).cast("int")))
    return _docs(spark, d).select("doc_id", X.estimate_tokens(F.col("text")).alias("prose"), X.estimate_tokens(F.col("text"), X.ratio_for(path)).alias("by_path"))


@query("t9_strip_ansi", r"SELECT doc_id, md5(regexp_replace(chr(27) || '[1;31m' || text || chr(27) || '[0m', '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g')) AS md5 FROM documents")
def _(spark, d):
    esc = F.lit("\x1b")
    return _docs(spark, d).select("doc_id", F.md5(X.strip_ansi(F.concat(esc, F.lit("[1;31m"), F.col("text"), esc, F.lit("[0m"))).cast("binary")).alias("md5"))


@query("t10_collapse_repeats")
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.collapse_repeats(F.col("text")).alias("folded")).select("doc_id", F.length("folded").cast("long").alias("n_chars"), F.md5(F.col("folded").cast("binary")).alias("md5"))


# texts between terminal codes, CRLF ends, blank runs and a hexadecimal run; JSON payloads of events, spaced out
@query("t10_preprocess")
def _(spark, d):
    esc, blob = F.lit("\x1b[1m"), F.lit("\r\n\r\n\r\n\r\n" + "0a1b2c3d" * 16 + " end\r\n")
    texts = _docs(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(esc, "text", blob).alias("text"))
    spaced = spread(table(spark, d, "events").select("event_id", "props")).select(F.concat(F.lit("e"), "event_id").alias("id"), F.regexp_replace("props", ":", "  :   ").alias("text"))
    return texts.union(spaced).select("id", X.preprocess(F.col("text")).alias("t")).select("id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("md5"))


_SECRET_SQL = r"""(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*[''"][^''"\n]{8,}[''"]"""


@query("t11_redact_secrets", rf"""SELECT doc_id, md5(regexp_replace(text, '{_SECRET_SQL}', '[REDACTED:generic-secret]', 'g')) AS md5, CASE WHEN regexp_matches(text, '{_SECRET_SQL}') THEN 'generic-secret' ELSE '' END AS labels FROM documents""")
def _(spark, d):
    r = _docs(spark, d).select("doc_id", X.redact_secrets(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("md5"), F.array_join("r.labels", ",").alias("labels"))


@query("t15_fingerprint", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))) AS fingerprint FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query("t16_recovery_handle", "SELECT doc_id, 'tsr_' || sha256(text)[1:32] AS handle FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", X.recovery_handle(F.col("text")).alias("handle"))


def _case_sql(column: str) -> str:
    q = lambda p: p.replace("'", "''")
    last = X.OUTPUT_TASKS[-1]
    whens = " ".join(f"WHEN regexp_matches({column}, '{q(p)}') THEN '{n}'" for n, p in X.OUTPUT_TASKS[:-1])
    return f"CASE WHEN {column} = '' THEN NULL {whens} WHEN regexp_matches({column}, '{q(last[1])}') OR {column} LIKE '%?' THEN '{last[0]}' END"


@query(
    "t20_classify_task",
    rf"""SELECT conv_id, turn, {_case_sql("p")} AS task, CASE WHEN regexp_matches(text, '{X.DETAILED}') THEN 'detailed' WHEN regexp_matches(text, '{X.TERSE}') THEN 'terse' END AS mode
 FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM conversations)""",
)
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.classify_task(F.col("text")).alias("task"), X.explicit_mode(F.col("text")).alias("mode"))


@query(
    "t21_complexity",
    "SELECT conv_id, turn, w AS n_words, CASE WHEN s >= 6 THEN 'extended' WHEN s >= 4 THEN 'complex' WHEN s >= 2 THEN 'standard' ELSE 'simple' END AS tier FROM (SELECT *, (w > 20)::INT + (w > 80)::INT * 2 + (w > 300)::INT * 2 + (text LIKE '%?%')::INT + (text LIKE '%' || chr(10) || '%')::INT AS s FROM (SELECT *, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS BIGINT) AS w FROM conversations))",
)
def _(spark, d):
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")).cast("long")
    s = (F.col("n_words") > 20).cast("int") + (F.col("n_words") > 80).cast("int") * 2 + (F.col("n_words") > 300).cast("int") * 2 + F.col("text").contains("?").cast("int") + F.col("text").contains("\n").cast("int")
    own = table(spark, d, "conversations").withColumn("n_words", n).withColumn("s", s)
    return own.select("conv_id", "turn", "n_words", F.when(F.col("s") >= 6, "extended").when(F.col("s") >= 4, "complex").when(F.col("s") >= 2, "standard").otherwise("simple").alias("tier"))


@query("t24_evidence_category", "SELECT page_id, CASE WHEN p LIKE '%.sql' OR p LIKE '%migrations/%' THEN 'database' WHEN p LIKE '%.github/workflows/%' THEN 'ci' WHEN p LIKE '%test%' OR p LIKE '%spec%' THEN 'tests' WHEN regexp_matches(p, '\\.(json|yaml|yml|toml|env\\.example|env\\.sample)$') THEN 'config' ELSE 'source' END AS category FROM (SELECT page_id, lower(url) || (CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '/a.sql' WHEN 1 THEN '/.github/workflows/x' WHEN 2 THEN '/tests/a.py' WHEN 3 THEN '/a.toml' ELSE '/a.py' END) AS p FROM pages)")
def _(spark, d):
    ends = F.array(*[F.lit(x) for x in ("/a.sql", "/.github/workflows/x", "/tests/a.py", "/a.toml", "/a.py")])
    return table(spark, d, "pages").select("page_id", X.evidence_category(F.concat("url", F.get(ends, (F.col("page_id") % 5).cast("int")))).alias("category"))


@query("t25_detect_failure", r"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 2) <> 0 ELSE regexp_matches(event_type, '(?im)^\s*(?:FAIL|FAILED|ERROR|FATAL|PANIC)\b') END AS failed FROM events")
def _(spark, d):
    code = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2)
    return table(spark, d, "events").select("event_id", X.detect_failure(F.col("event_type"), code).alias("failed"))


@query("t28_command_hash", r"SELECT conv_id, turn, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS command FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.normalized_command(F.col("text")), 256).alias("command"))


@query("a1_jaccard", "WITH s AS (SELECT p_partkey, list_distinct(string_split(p_type, ' ')) AS a, list_distinct(string_split(p_brand || ' ' || p_type, ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS score FROM s")
def _(spark, d):
    a, b = F.split("p_type", " "), F.split(F.concat_ws(" ", "p_brand", "p_type"), " ")
    return table(spark, d, "part").select("p_partkey", F.round(X.jaccard(F.array_distinct(a), F.array_distinct(b)), 6).alias("score"))


@query(
    "a2_l2_cosine_topk",
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings) SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) WHERE rk <= 5",
)
def _(spark, d):
    from tessera.operators.vectors import exact_top_k

    e = table(spark, d, "embeddings")
    return exact_top_k(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", "embedding"), 5).drop("rank")


@query("a3_json_pointer", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    from tessera.functions.json import select_pointer

    return table(spark, d, "events").select("event_id", select_pointer(F.col("props"), "/k").cast("long").alias("k"))


@query("a5_pointer_candidates", "SELECT DISTINCT page_id, p AS pointer FROM (SELECT page_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS p FROM (SELECT page_id, list_transform(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '*' ELSE x END) AS parts FROM pages))")
def _(spark, d):
    from tessera.functions.json import pointer_candidates

    return table(spark, d, "pages").select("page_id", F.explode(pointer_candidates(F.regexp_replace("url", "^[a-z]+://", ""))).alias("pointer")).distinct()


@query("a4_field_paths", "SELECT DISTINCT event_id, unnest(json_keys(props)) AS path FROM events")
def _(spark, d):
    from tessera.functions.json import field_paths

    return table(spark, d, "events").select("event_id", F.explode(field_paths(F.col("props"))).alias("path"))


@query("a13_reciprocal_rank", "SELECT o_orderkey, round(CASE WHEN r <= 0 THEN 0 ELSE 1.0::DOUBLE / (60 + r) END, 8) AS score FROM (SELECT o_orderkey, o_orderkey % 100 AS r FROM orders)")
def _(spark, d):
    from tessera.operators.ranking import reciprocal_rank

    return table(spark, d, "orders").select("o_orderkey", F.round(reciprocal_rank(F.col("o_orderkey") % 100), 8).alias("score"))


@query("a14_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query(
    "a15_rounded_index_percentile",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(max(value) FILTER (WHERE i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)), 6) AS p50, round(max(value) FILTER (WHERE i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)), 6) AS p95 FROM r GROUP BY event_type",
)
def _(spark, d):
    from tessera.operators.stats import rounded_index_percentiles

    return rounded_index_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("a16_nearest_rank_percentile", "SELECT event_type, round(quantile_disc(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)"), 6).alias("p90"))


@query("a17_overlap_ratio", "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y, round(greatest(0, least(a.l_partkey + 40, b.l_partkey + 20) - greatest(a.l_partkey, b.l_partkey)) / 20.0::DOUBLE, 6) AS ratio FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def _(spark, d):
    from tessera.operators.intervals import overlap_ratio

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = li.toDF("l_orderkey", "y", "b0")
    own = li.toDF("l_orderkey", "x", "a0").join(b, "l_orderkey").where("x < y")
    return own.select("l_orderkey", "x", "y", F.round(overlap_ratio(F.col("a0"), F.col("a0") + 40, F.col("b0"), F.col("b0") + 20), 6).alias("ratio"))


@query(
    "a18_merge_windows",
    "WITH w AS (SELECT l_suppkey, l_partkey AS a, l_partkey + 15 AS z FROM lineitem), m AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM w), g AS (SELECT *, sum(f) OVER (PARTITION BY l_suppkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT l_suppkey, min(a) AS start_at, max(z) AS end_at FROM g GROUP BY l_suppkey, grp",
)
def _(spark, d):
    from tessera.operators.intervals import merge_windows

    w = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("start_at"), (F.col("l_partkey") + 15).alias("end_at"))
    return merge_windows(w, ["l_suppkey"])


@query("a19_day_window", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).select("event_id", F.unix_timestamp("ts").alias("at"))


@query(
    "f2_critical_lines",
    r"WITH l AS (SELECT doc_id, line, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '(?i)(error|token|license)') GROUP BY doc_id, line) SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM l) WHERE rk <= 20",
)
def _(spark, d):
    from tessera.operators.compaction import matching_lines

    return matching_lines(_docs(spark, d), "doc_id", "(?i)(error|token|license)", 20).select("doc_id", "line")


@query(
    "f3_keep_matching",
    r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rk FROM l WHERE regexp_matches(line, '(?i)(token|license)')), s AS (SELECT doc_id, sum(length(line) + 1) AS kept, count(*) AS n_lines FROM k WHERE rk <= 40 GROUP BY doc_id) SELECT s.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(kept AS BIGINT) AS kept FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE kept < length(d.text)",
)
def _(spark, d):
    from tessera.operators.compaction import keep_matching

    return keep_matching(_docs(spark, d), "doc_id", "(?i)(token|license)", 40)


@query("f4_time_window", "SELECT event_id, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03 00:00:00'")
def _(spark, d):
    return table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-03 00:00:00").cast("timestamp"))).select("event_id", "value")


@query("f5_like_escape", r"SELECT doc_id FROM documents WHERE text ILIKE '%token = %' ESCAPE '!'")
def _(spark, d):
    from tessera.functions.predicates import contains_ignoring_case

    return _docs(spark, d).where(contains_ignoring_case(F.col("text"), "token = ")).select("doc_id")


@query("f6_in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'")
def _(spark, d):
    from tessera.functions.predicates import conjunction

    return table(spark, d, "orders").where(conjunction({"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT"})).select("o_orderkey")


@query("f7_leakage", "SELECT item_id, (lower(text) LIKE '%thtion%' OR lower(text) LIKE '%nicht%') AS leaks FROM benchmark")
def _(spark, d):
    from tessera.functions.predicates import leaks

    return table(spark, d, "benchmark").select("item_id", leaks(F.col("text"), ["thtion", "nicht"]).alias("leaks"))


@query("f9_size_gate", "SELECT doc_id, strlen(text) AS before, strlen(s) AS after, strlen(s) <= strlen(text) * 0.98 AS accepted FROM (SELECT doc_id, text, regexp_replace(text, '[ \\t\\n]+', ' ', 'g') AS s FROM documents)")
def _(spark, d):
    short = F.regexp_replace("text", r"[ \t\n]+", " ")
    own = _docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("before"), F.octet_length(short).cast("long").alias("after"))
    return own.withColumn("accepted", F.col("after") <= F.col("before") * 0.98)


@query("s6_load_events", "SELECT event_id, event_type FROM events WHERE json_valid(props) AND ts IS NOT NULL AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
def _(spark, d):
    from tessera.sources.events import valid_events

    return valid_events(table(spark, d, "events"), "2024-01-02 00:00:00").select("event_id", "event_type")


@query("s7_keep_newest", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk <= 4000")
def _(spark, d):
    from tessera.sources.events import newest

    return newest(table(spark, d, "events"), 4000, ["ts", "event_id"]).select("event_id")


@query("s22_output_pages", "SELECT doc_id, i - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i > 1 AND i <= 4")
def _(spark, d):
    from tessera.operators.compaction import line_range

    return line_range(_docs(spark, d), "doc_id", 1, 3)


@query("s10_recovery_put", "SELECT 'tsr_' || sha256(text)[1:32] AS handle, CAST(min(length(text)) AS BIGINT) AS n_chars, min(doc_id) AS first_doc FROM documents GROUP BY text")
def _(spark, d):
    own = _docs(spark, d).select(X.recovery_handle(F.col("text")).alias("handle"), F.length("text").cast("long").alias("n_chars"), "doc_id")
    return own.groupBy("handle").agg(F.min("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


@query("s4_incremental_index", "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'parse' WHEN n.doc_id IS NULL THEN 'drop' WHEN o.digest = n.digest THEN 'reuse' ELSE 'parse' END AS action FROM (SELECT doc_id, md5(text || (CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END)) AS digest FROM documents WHERE doc_id % 11 <> 0) o FULL JOIN (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 13 <> 0) n ON o.doc_id = n.doc_id")
def _(spark, d):
    from tessera.sources.index import incremental_actions

    docs = _docs(spark, d)
    digest = lambda c: F.md5(c.cast("binary"))
    old = docs.where("doc_id % 11 <> 0").select("doc_id", digest(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))).alias("digest"))
    return incremental_actions(old, docs.where("doc_id % 13 <> 0").select("doc_id", digest(F.col("text")).alias("digest")), "doc_id")


