"""Queries of promotion stages, module references, images, JSON forms, waste signals, diagnostics and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import images
from tessera.functions import json as J
from tessera.operators import modules, promotion, sessions, stats
from tessera.plans.registry import query, table

_AS_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("a8_json_anomaly", "SELECT event_id, CAST(props->>'k' AS INT) % 5 IN (0, 1) OR event_type = 'error' AND CAST(props->>'k' AS INT) % 3 = 1 AS anomaly FROM events")
def _(spark, d):
    """Objects with a named trouble, an empty one, a zero, a bad or a good state."""
    k = F.get_json_object("props", "$.k").cast("int")
    named = F.element_at(F.array(*[F.lit(x) for x in ('"lastError":"x"', '"n_failed":[1]', '"warnings":[]', '"exception":0.0', '"a":"error"')]), k % 5 + 1)
    state = F.when(k % 3 == 1, F.concat(F.lit('"Level":"'), F.upper("event_type"), F.lit('"'))).otherwise('"status":"fine"')
    return table(spark, d, "events").select("event_id", J.json_anomaly(F.concat(F.lit("{"), named, F.lit(","), state, F.lit("}"))).alias("anomaly"))


@query("a9_x12_canonical_json", """SELECT item_id, sha256('{"a":{"x":[3,' || item_id || '],"y":null},"b":"' || replace(text, chr(10), '\\n') || '","é":true}') AS digest FROM benchmark""")
def _(spark, d):
    text = F.replace("text", F.lit("\n"), F.lit("\\n"))
    given = F.concat(F.lit('{ "é" : true, "b":"'), text, F.lit('", "a":{"y":null ,"x":[ 3, '), F.col("item_id").cast("string"), F.lit("]}}"))
    return table(spark, d, "benchmark").select("item_id", F.sha2(J.canonical_json(given), 256).alias("digest"))


_TOKENS = """WITH s AS (SELECT p_partkey, w, h, 1568.0::DOUBLE / greatest(w, h, 1568) AS s FROM (SELECT p_partkey, (p_partkey * 37) % 6000 AS w, (p_partkey * 101) % 5000 AS h FROM part)),
 t AS (SELECT p_partkey, w, h, CASE WHEN s < 1 THEN greatest(1, floor(w * s)) ELSE w END AS a, CASE WHEN s < 1 THEN greatest(1, floor(h * s)) ELSE h END AS b FROM s),
 u AS (SELECT *, ceil(a / 28.0::DOUBLE) * ceil(b / 28.0::DOUBLE) AS n FROM t)
 SELECT p_partkey, CAST(CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN n <= 1568 THEN n ELSE least(1568, ceil(greatest(1, floor(a * sqrt(1568.0::DOUBLE / n))) / 28.0::DOUBLE) * ceil(greatest(1, floor(b * sqrt(1568.0::DOUBLE / n))) / 28.0::DOUBLE)) END AS BIGINT) AS tokens FROM u"""


@query("a12_image_tokens", _TOKENS)
def _(spark, d):
    """The standard tier, with edges and areas beyond it."""
    size = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 6000).alias("w"), (F.col("p_partkey") * 101 % 5000).alias("h"))
    return size.select("p_partkey", images.image_tokens(F.col("w"), F.col("h"), high=False).alias("tokens"))


_CALL_SQL = "SELECT *, year(ts) AS turn, md5(CAST(CAST(props->>'k' AS INT) % 2 AS VARCHAR)) AS o, event_type = 'error' AS bad, event_type = 'purchase' AS edit FROM events"


@query(
    "w6_all_waste_signals",
    f"""WITH c AS ({_CALL_SQL}), f AS (SELECT * FROM c WHERE bad),
 r AS (SELECT user_id, turn, 'repeat' AS signal, event_type AS about, ts, event_id FROM (SELECT *, list({{'t': turn, 'c': event_type}}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM c) WHERE len(list_filter(l, lambda x: x.t = turn AND x.c = event_type)) >= 3
 UNION ALL SELECT user_id, turn, 'retry', event_type || ':' || md5(o), ts, event_id FROM (SELECT *, list({{'t': turn, 'c': event_type, 'o': o}}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM f) AS q WHERE len(list_filter(l, lambda x: x.t = q.turn AND x.c = q.event_type AND x.o = q.o)) >= 3
 UNION ALL SELECT user_id, turn, 'cascade', '', ts, event_id FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE edit) OVER w AS e FROM c WINDOW w AS (PARTITION BY user_id, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE n >= 12 AND e = 0)
 SELECT user_id, turn, signal, about, arg_min(event_id, (ts, event_id)) AS event_id FROM r GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    calls = table(spark, d, "events").withColumns({"turn": F.year("ts").cast("long"), "o": F.md5((k % 2).cast("string").cast("binary")), "bad": F.col("event_type") == "error", "edit": F.col("event_type") == "purchase"})
    told = sessions.waste_signals(calls, "user_id", "turn", ["ts", "event_id"], "event_type", "o", F.col("bad"), F.col("edit"))
    return told.select("user_id", "turn", "signal", "about", "event_id")


@query(
    "st5_diagnostics_delta",
    """WITH s AS (SELECT event_id, user_id, event_type, ts, list_distinct(CASE WHEN CAST(props->>'k' AS INT) % 7 = 0 THEN [] ELSE ['e' || CAST(props->>'k' AS INT) % 5, 'w' || CAST(props->>'k' AS INT) % 3, 'all'] END) AS found FROM events),
 p AS (SELECT *, lag(found) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM s)
 SELECT event_id, array_to_string(list_sort(list_filter(found, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(found, x))), ',') AS resolved, array_to_string(list_sort(list_filter(found, lambda x: list_contains(b, x))), ',') AS remaining FROM p WHERE len(b) > 0""",
)
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    found = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), (k % 5).cast("string")), F.concat(F.lit("w"), (k % 3).cast("string")), F.lit("all")))
    delta = sessions.diagnostics_delta(table(spark, d, "events").withColumn("found", found), ["user_id", "event_type"], ["ts", "event_id"], "found")
    return delta.where("added is not null").select("event_id", *[F.array_join(c, ",").alias(c) for c in ("added", "resolved", "remaining")])


@query("x8_quality_kept", "WITH q AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) / 1000 AS b, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) / 1000 AS o, bool_and(o_orderstatus <> 'P') AS ok, count(*) % 3 = 0 AS blocked FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN b IS NOT NULL AND o IS NOT NULL THEN ok AND NOT blocked AND o >= b - 0.1 END AS kept FROM q")
def _(spark, d):
    side = lambda r: F.avg(F.when(F.col("o_orderkey") % 2 == r, F.col("o_totalprice"))) / 1000
    q = table(spark, d, "orders").groupBy("o_custkey").agg(side(0).alias("b"), side(1).alias("o"), F.bool_and(F.col("o_orderstatus") != "P").alias("ok"), (F.count("*") % 3 == 0).alias("blocked"))
    run = lambda v, blocked: {"success": F.col("ok"), "blocker": blocked, "correctness": F.col(v), "safety": F.lit(3.0) + F.col(v) * 0, "weighted": F.col(v)}
    return q.select("o_custkey", stats.quality_kept(run("b", F.lit(False)), run("o", F.col("blocked"))).alias("kept"))


_GATES = """WITH t AS (SELECT o_custkey % 31 % 7 * (o_custkey % 31) AS cohort, o_custkey, count(*) AS n, avg(o_totalprice) - 200000 AS v, bool_and(o_orderkey % 97 <> 0) AS frozen FROM orders GROUP BY 1, 2),
 g AS (SELECT cohort, count(*) AS tasks, min(n) AS trials, bool_and(frozen) AS frozen, avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)) AS low FROM t GROUP BY 1)
 SELECT cohort, array_to_string(list_filter([CASE WHEN tasks < 20 THEN 'tasks' END, CASE WHEN trials < 3 THEN 'trials' END, CASE WHEN NOT frozen THEN 'frozen' END, CASE WHEN low IS NULL OR low <= 0 THEN 'interval' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g"""


@query("x9_g22_gate_reasons", _GATES)
def _(spark, d):
    tasks = table(spark, d, "orders").groupBy((F.col("o_custkey") % 31 % 7 * (F.col("o_custkey") % 31)).alias("cohort"), "o_custkey").agg(F.count("*").alias("n"), (F.avg("o_totalprice") - 200000).alias("v"), F.bool_and(F.col("o_orderkey") % 97 != 0).alias("frozen"))
    g = tasks.groupBy("cohort").agg(F.count("*").alias("tasks"), F.min("n").alias("trials"), F.bool_and("frozen").alias("frozen"), (F.avg("v") - 1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("low"))
    gates = {"tasks": F.col("tasks") >= 20, "trials": F.col("trials") >= 3, "frozen": F.col("frozen"), "interval": F.col("low") > 0}
    return g.select("cohort", F.array_join(stats.failed_gates(gates), ",").alias("reasons"))


@query("x5_reduction_intervals")
def _(spark, d):
    """Reduction of price and of lines a success between even and odd orders, clusters are customers."""
    even = F.col("o_orderkey") % 2 == 0
    won = (F.col("o_orderstatus") != "P").cast("int")
    pick = lambda side, value: F.when(side, value).otherwise(0)
    pairs = table(spark, d, "orders").select("o_custkey", pick(even, F.col("o_totalprice")).alias("cost_a"), pick(even, won).alias("wins_a"), pick(~even, F.col("o_totalprice")).alias("cost_b"), pick(~even, won).alias("wins_b"), pick(even, F.lit(1)).alias("runs_a"), pick(~even, F.lit(1)).alias("runs_b"))
    return stats.reduction_intervals(pairs, "o_custkey", {"cost_per_success": ("cost_a", "wins_a", "cost_b", "wins_b"), "cost": ("cost_a", "runs_a", "cost_b", "runs_b")})


_MODULES = ["./f{k}", "../m{m}/f{k}", "./a//../f{k}.ts", "left-pad", "./../../src/m{m}/./f{k}", "/f{k}"]
_KNOWN_SQL = "SELECT DISTINCT 'src/m' || o_orderkey % 20 || '/f' || o_orderkey || ['.ts', '.tsx', '/index.js', '', '.cjs', '.py'][o_orderkey % 6 + 1] AS path FROM orders"


@query(
    "gr6_resolved_modules",
    f"""WITH known AS ({_KNOWN_SQL}), refs AS (SELECT DISTINCT 'src/m' || l_orderkey % 20 || '/x.ts' AS src, l_orderkey AS k, l_linenumber % 6 AS form FROM lineitem),
 tried AS (SELECT src, form, k, 'src/m' || k % 20 || '/f' || k || CASE WHEN form = 2 THEN '.ts' ELSE '' END || e.e AS path, e.i AS i FROM refs, (SELECT unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'] AS l)) AS e WHERE form NOT IN (3, 5))
 SELECT src, replace(replace({_AS_LIST(_MODULES)}[form + 1], '{{k}}', CAST(k AS VARCHAR)), '{{m}}', CAST(k % 20 AS VARCHAR)) AS module, arg_min(path, i) AS path FROM tried JOIN known USING (path) GROUP BY 1, 2""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    ends = F.array(*[F.lit(x) for x in (".ts", ".tsx", "/index.js", "", ".cjs", ".py")])
    known = o.select(F.concat(F.lit("src/m"), F.col("o_orderkey") % 20, F.lit("/f"), F.col("o_orderkey"), F.get(ends, (F.col("o_orderkey") % 6).cast("int"))).alias("path"))
    form = F.get(F.array(*[F.lit(m) for m in _MODULES]), (F.col("l_linenumber") % 6).cast("int"))
    module = F.replace(F.replace(form, F.lit("{k}"), F.col("l_orderkey").cast("string")), F.lit("{m}"), (F.col("l_orderkey") % 20).cast("string"))
    refs = table(spark, d, "lineitem").select(F.concat(F.lit("src/m"), F.col("l_orderkey") % 20, F.lit("/x.ts")).alias("src"), module.alias("module"))
    return modules.resolve_modules(refs, known)


@query(
    "r16_w12_confidence_gate",
    """WITH RECURSIVE r AS (SELECT o_custkey AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CAST(500 - o_orderkey % 400 AS DOUBLE) / 7 AS base, CAST(500 - o_orderkey % 400 AS DOUBLE) / 7 + (o_orderkey % 5) * 20 AS score, CAST((o_orderkey * 7) % 32 AS INT) AS key FROM orders),
 f AS (SELECT q, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS item, CAST(NULL AS DOUBLE) AS raw, CAST(NULL AS DOUBLE) AS put, CAST([] AS STRUCT(k INT, s DOUBLE)[]) AS met FROM r GROUP BY 1
 UNION ALL SELECT q, i, item, score, put, list_append(met, {'k': key, 's': put}) FROM (SELECT r.q, r.i, r.item, r.score, r.key, f.met, CASE WHEN r.score > r.base AND b.b IS NOT NULL AND r.score > greatest(r.base, nextafter(b.b, '-inf'::DOUBLE)) THEN greatest(r.base, nextafter(b.b, '-inf'::DOUBLE)) ELSE r.score END AS put FROM f JOIN r ON r.q = f.q AND r.i = f.i + 1, LATERAL (SELECT list_min(list_transform(list_filter(f.met, lambda x: x.k > r.key OR x.k = r.key AND (r.key & 22) <> 0), lambda x: x.s)) AS b) AS b))
 SELECT q AS query_id, item, put AS score, put < raw AS gated FROM f WHERE i > 0""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    base = (500 - k % 400).cast("double") / 7
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("item"), k.alias("place"), base.alias("base"), (base + k % 5 * 20).alias("score"), (k * 7 % 32).alias("key"))
    return promotion.confidence_gate(ranked)


_KEY = "(CASE WHEN length({t}) > 4 AND {t} LIKE '%e' THEN left({t}, length({t}) - 1) ELSE {t} END)"
_ING = "(CASE WHEN length({t}) > 6 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3) ELSE {t} END)"
_FAMILY = _KEY.format(t=_ING.format(t="x"))


@query(
    "r15_peer_boost",
    f"""WITH w AS (SELECT p_partkey, list_distinct(list_transform(string_split(lower(p_name), ' '), lambda x: {_FAMILY})) AS l FROM part), g AS (SELECT list_transform({_AS_LIST(promotion.NO_FAMILY)}, lambda x: {_FAMILY}) AS l),
 f AS (SELECT p_partkey AS path, unnest(list_filter(w.l, lambda x: length(x) >= 3 AND NOT list_contains(g.l, x))) AS t FROM w, g),
 s AS (SELECT n_nationkey AS query_id, p_partkey AS seed, row_number() OVER (PARTITION BY n_nationkey ORDER BY p_partkey) AS rank FROM nation JOIN part ON p_partkey % 25 = n_nationkey QUALIFY rank <= 12),
 q AS (SELECT n_nationkey AS query_id, unnest(l) AS t FROM nation JOIN w ON p_partkey = n_nationkey + 1),
 m AS (SELECT s.query_id, a.path, s.seed, s.rank, count(*) AS n, count(q.t) AS k FROM s JOIN f AS b ON b.path = s.seed JOIN f AS a ON a.t = b.t AND a.path <> s.seed LEFT JOIN q ON q.query_id = s.query_id AND q.t = a.t GROUP BY 1, 2, 3, 4)
 SELECT query_id, path, seed, CAST(least(20, 6 + 3 * n + 2 * k) AS DOUBLE) AS boost FROM m WHERE n >= 2 AND k >= 1 QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY n DESC, k DESC, rank) = 1""",
)
def _(spark, d):
    from pyspark.sql import Window

    files = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.split(F.lower("p_name"), " ").alias("terms"))
    nation = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id")))  # 25 rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("path"))
    seeds = files.join(nation, F.col("path") % 25 == F.col("query_id")).withColumn("rank", rank).where("rank <= 12")
    return promotion.peer_boosts(files, seeds, files.join(nation, F.col("path") == F.col("query_id") + 1).select("query_id", "terms"))


@query(
    "r19_parent_credit",
    """WITH c AS (SELECT o_custkey AS path, 'o' || o_orderkey AS name, o_orderkey AS a, o_orderkey + 3 AS b, CASE o_orderkey % 3 WHEN 0 THEN ' export function f' WHEN 1 THEN 'class c' END AS sig FROM orders),
 m AS (SELECT o_custkey AS path, 'l' || l_orderkey || '.' || l_linenumber AS name, 'o' || l_orderkey AS parent, l_orderkey + l_linenumber % 4 AS a, l_orderkey + l_linenumber AS b, l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT path, name, '', a, b, 20 FROM c WHERE a % 5 = 0),
 e AS (SELECT c.path, c.name, c.a, c.b, m.score FROM m JOIN c ON m.path = c.path AND m.parent = c.name WHERE m.score > 0 AND (c.a <= m.a AND m.b <= c.b OR c.sig = ' export function f'))
 SELECT path, name, a AS start, b AS "end", max(CAST(score AS DOUBLE)) AS score FROM (SELECT path, name, a, b, score FROM m UNION ALL SELECT * FROM e) GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    from tessera.sources.tables import dealt, parts

    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    place = [F.col("o_custkey").alias("path"), F.concat(F.lit("o"), k).alias("name"), k.alias("start"), (k + 3).alias("end")]
    containers = orders.select(*place, F.when(k % 3 == 0, " export function f").when(k % 3 == 1, "class c").alias("signature"))
    line = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    n = parts(lines)
    own = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == k)
    members = own.select(F.col("o_custkey").alias("path"), F.concat(F.lit("l"), k, F.lit("."), line).alias("name"), F.concat(F.lit("o"), k).alias("parent"), (k + line % 4).alias("start"), (k + line).alias("end"), F.col("l_quantity").cast("double").alias("score"))
    named = orders.where(k % 5 == 0).select(*place, F.lit("").alias("parent"), F.lit(20.0).alias("score"))
    return promotion.parent_credit(members.unionByName(named), containers, n)


@query("r11_query_views")
def _(spark, d):
    """Every benchmark item as a query."""
    from tessera.functions.prompts import query_views

    return table(spark, d, "benchmark").select("item_id", F.posexplode(query_views(F.col("text"))).alias("place", "view"))
