"""Queries of prompts and commands, line windows, logs, section budgets and distinct hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.operators import budget, compaction
from tessera.plans.more_queries import _REDACTED_SQL
from tessera.plans.registry import query, table

_COMMANDS = ["A=1 B=2 sudo git status -s", "python -m pytest -q", "/usr/bin/python3 -m a/b", "npm run build --x", "env cargo test", "ls -la /tmp", "./run X=1", "", "KEY=secret", "time kubectl", "uv pip install x", "yarn build"]
_FAMILIES = ["git status", "python -m pytest", "python3 -m b", "npm run build", "cargo test", "ls", "run", "unknown", "unknown", "kubectl", "uv pip", "yarn"]


@query("t13_command_signature", f"SELECT o_orderkey, {_FAMILIES}[CAST(o_orderkey % {len(_FAMILIES)} AS INT) + 1] AS family FROM orders")
def _(spark, d):
    pick = F.get(F.array(*[F.lit(c) for c in _COMMANDS]), (F.col("o_orderkey") % len(_COMMANDS)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", P.command_signature(pick).alias("family"))


_q = lambda s: s.replace("'", "''")


# every third text is followed by sentences that decide something
_MORE = " We must keep it.  Use token=abc here! Nothing else.\nPlease do not go."


@query(
    "t17_decisions",
    f"""WITH s AS (SELECT doc_id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN {"' || chr(10) || '".join(["'" + x + "'" for x in _MORE.split(chr(10))]).replace("' || chr(10) || ''", "' || chr(10) || '").replace("'' || chr(10)", "' || chr(10)")} ELSE '' END, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS a FROM documents))),
 r AS (SELECT doc_id, i, ({_REDACTED_SQL})[1:240] AS r FROM s WHERE text <> '' AND regexp_matches(text, '{_q(P.DECISION)}')), f AS (SELECT doc_id, r, min(i) AS i FROM r WHERE r <> '' GROUP BY 1, 2)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS place, md5(r) AS md5 FROM f QUALIFY place <= 3""",
)
def _(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, _MORE).otherwise(""))
    found = table(spark, d, "documents").select("doc_id", F.posexplode(P.decision_summaries(text)).alias("i", "r"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), F.md5(F.col("r").cast("binary")).alias("md5"))


_RISKY = [" plain", " Deploy the release", " data loss and DEADLOCK", " billing"]


@query("t22_risk", f"SELECT doc_id, CASE WHEN len(w) > 0 THEN 'high' ELSE 'normal' END AS level, array_to_string(w[1:8], ',') AS words FROM (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text || {_RISKY}[CAST(doc_id % 4 AS INT) + 1], '{P.HIGH_RISK}', 1), lambda x: lower(x)))) AS w FROM documents)")
def _(spark, d):
    found = P.risk(F.concat("text", F.get(F.array(*[F.lit(r) for r in _RISKY]), (F.col("doc_id") % 4).cast("int"))))
    return table(spark, d, "documents").select("doc_id", found.alias("r")).select("doc_id", "r.level", F.array_join("r.words", ",").alias("words"))


_TASKS, _TIERS = ["general", "debugging", "coding", "planning", "review"], ["simple", "complex", "extended"]


@query(
    "t22_minimum_capability",
    f"""SELECT o_orderkey, ['fast', 'balanced', 'deep'][greatest(CASE WHEN task IN ('debugging', 'review') THEN 2 ELSE 1 END, CASE WHEN task <> 'general' THEN (CASE tier WHEN 'extended' THEN 3 WHEN 'complex' THEN 2 ELSE 1 END) WHEN tier <> 'simple' THEN 2 ELSE 1 END,
 CASE WHEN risky THEN (CASE WHEN tier <> 'simple' THEN 3 ELSE 2 END) ELSE 1 END)] AS capability FROM (SELECT o_orderkey, {_TASKS}[CAST(o_orderkey % 5 AS INT) + 1] AS task, {_TIERS}[CAST(o_custkey % 3 AS INT) + 1] AS tier, o_orderstatus = 'F' AS risky FROM orders)""",
)
def _(spark, d):
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs)).cast("int"))
    level = F.when(F.col("o_orderstatus") == "F", "high").otherwise("normal")
    return table(spark, d, "orders").select("o_orderkey", P.minimum_capability(pick(_TASKS, "o_orderkey"), pick(_TIERS, "o_custkey"), level).alias("capability"))


@query(
    "b2_section_budget",
    """WITH o AS (SELECT o_orderkey, o_custkey AS remaining, o_orderkey % 7 AS idx, o_orderkey % 4 AS selected, 5 AS max_files, 3 + o_custkey % 5 AS n, o_orderstatus = 'F' AS authority, o_custkey % 6 AS coverage, o_custkey % 3 = 0 AS pending, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 6 END AS pidx, 450 AS pres FROM orders),
 b AS (SELECT *, CASE WHEN selected + 1 < max_files AND idx + 1 < n THEN least(remaining, greatest(remaining * (CASE WHEN authority THEN 3 ELSE 2 END) // 5, 300)) ELSE remaining END AS own,
  (CASE WHEN coverage > 0 AND idx < coverage THEN greatest(0, coverage - idx - 1) * 300 ELSE 0 END) + (CASE WHEN pending THEN (CASE WHEN pidx IS NOT NULL AND idx < pidx AND pidx < coverage THEN greatest(0, pres - 300) ELSE pres END) ELSE 0 END) AS reserve FROM o)
 SELECT o_orderkey, CAST(CASE WHEN remaining <= 0 THEN 0 WHEN reserve > 0 THEN least(own, greatest(0, remaining - reserve)) ELSE own END AS BIGINT) AS tokens FROM b""",
)
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = budget.section_budget(c, k % 7, k % 4, F.lit(5), 3 + c % 5, F.col("o_orderstatus") == "F", c % 6, c % 3 == 0, F.when(k % 2 == 0, c % 6), F.lit(450))
    return table(spark, d, "orders").select("o_orderkey", own.alias("tokens"))


_LINES_SQL = "SELECT doc_id, CASE WHEN w[-1] = '' THEN w[1:len(w) - 1] ELSE w END AS a FROM (SELECT doc_id, string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS w FROM documents)"


# windows of six lines with two in common, over lines of single sentences
@query(
    "l5_rank_windows",
    f"""WITH l AS (SELECT doc_id, string_split(replace(array_to_string(a, ' '), '. ', chr(10)), chr(10)) AS b FROM ({_LINES_SQL})), m AS (SELECT doc_id, CASE WHEN b[-1] = '' THEN b[1:len(b) - 1] ELSE b END AS a FROM l),
 w AS (SELECT doc_id, a, unnest(generate_series(1, greatest(1, len(a) - 2), 4)) AS start_at FROM m WHERE len(a) > 0), x AS (SELECT *, least(len(a), start_at + 5) AS end_at, lower(array_to_string(a[start_at:least(len(a), start_at + 5)], chr(10))) AS body FROM w),
 s AS (SELECT doc_id, start_at, end_at, 2.0::DOUBLE * (least(8, (length(body) - length(replace(body, 'the', ''))) // 3) + least(8, (length(body) - length(replace(body, 'and', ''))) // 3)) + CASE WHEN start_at = 1 THEN 0.25 ELSE 0 END
  + (CASE WHEN contains(body, 'the') AND regexp_matches(body, '\\b(?:class|def|function|async\\s+function|interface|type|const|let|var)\\s+the\\b') THEN 5 ELSE 0 END) + (CASE WHEN contains(body, 'and') AND regexp_matches(body, '\\b(?:class|def|function|async\\s+function|interface|type|const|let|var)\\s+and\\b') THEN 5 ELSE 0 END) AS score FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start_at) AS rk, row_number() OVER (PARTITION BY doc_id ORDER BY start_at) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n, max(score) OVER (PARTITION BY doc_id) AS best FROM s)
 SELECT doc_id, start_at, end_at, score FROM r WHERE CASE WHEN best > 0 THEN score > 0 AND rk <= 8 ELSE pos IN (0, n // 2, n - 1) END""",
)
def _(spark, d):
    text = F.replace(F.array_join(_lines("text"), " "), F.lit(". "), F.lit("\n"))
    found = compaction.ranked_windows(text, F.array(F.lit("the"), F.lit("and")), 6, 2)
    out = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(found).alias("w"))
    return out.select("doc_id", F.col("w.start_at").cast("long").alias("start_at"), F.col("w.end_at").cast("long").alias("end_at"), "w.score")


def _lines(name: str):
    from tessera.functions.text import lines

    return lines(F.col(name))


@query(
    "w14_compress_log",
    f"""WITH l AS (SELECT doc_id, string_split(replace(array_to_string(a, ' '), '. ', chr(10)), chr(10)) AS b FROM ({_LINES_SQL})), m AS (SELECT doc_id, array_to_string(b, chr(10)) AS text, CASE WHEN b[-1] = '' THEN b[1:len(b) - 1] ELSE b END AS a FROM l), e AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: {{'i': i, 'x': a[i]}}) AS r FROM m),
 h AS (SELECT *, list_filter(r, lambda q: q.i > 3 AND q.i <= len(a) - 3 AND (regexp_matches(q.x, '(?i)(error|exception|fail|fatal|panic|traceback|assert|caused by)') OR contains(lower(q.x), 'sh')))[1:4] AS mid FROM e)
 SELECT doc_id, md5(CASE WHEN len(a) <= 10 THEN text ELSE '[log: ' || len(a) || ' lines -> ' || (6 + len(mid)) || ' retained]' || chr(10) || array_to_string(list_concat(list_concat(a[1:3], list_transform(mid, lambda q: q.x)), a[len(a) - 2:]), chr(10)) || chr(10) END) AS md5 FROM h""",
)
def _(spark, d):
    text = F.replace(F.array_join(_lines("text"), " "), F.lit(". "), F.lit("\n"))
    own = table(spark, d, "documents").where("text is not null").select("doc_id", compaction.compressed_log(text, F.array(F.lit("sh")), max_lines=10, edge=3).alias("t"))
    return own.select("doc_id", F.md5(F.col("t").cast("binary")).alias("md5"))


@query("w10_distinct_hits")
def _(spark, d):
    hit = F.struct((-F.col("l_extendedprice")).alias("less"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 40).alias("start_at"), (F.col("l_partkey") % 40 + F.col("l_quantity").cast("long") % 20).alias("end_at"))
    hits = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return hits.select("l_orderkey", F.explode(compaction.distinct_hits(F.col("hits"))).alias("h")).select("l_orderkey", F.col("h.n").alias("l_linenumber"), "h.start_at", "h.end_at")
