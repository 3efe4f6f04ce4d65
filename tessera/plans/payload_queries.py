"""Queries of payloads: web pages, nested JSON, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query, table


@query("h1_visible_lines")  # no SQL reads markup with a stack: tested against a parser
def _(spark, d):
    from tessera.operators import pages

    return pages.visible_lines(table(spark, d, "pages"))


@query("h2_focused_lines")  # over h1's lines: tested against a version page by page
def _(spark, d):
    from tessera.operators import pages

    own = table(spark, d, "pages")
    return pages.focused(pages.visible_lines(own), own.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("query")), 30)


def edited(spark, d):
    """patch_id, text, n: for each document a diff that replaces the lines whose length leaves 3 when divided by 7, and a line more of context."""
    from tessera.functions.text import lines

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("patch_id"), lines(F.coalesce("text", F.lit(""))).alias("l"))
    at = F.transform("l", lambda x, i: F.struct((i + 1).cast("string").alias("i"), x.alias("x")))
    hunks = F.transform(F.filter(at, lambda s: F.length(s["x"]) % 7 == 3), lambda s: F.concat(F.lit("@@ -"), s["i"], F.lit(" +"), s["i"], F.lit(" @@\n-"), s["x"], F.lit("\n+"), s["x"], F.lit(" edited\n")))
    path = F.concat(F.lit("src/doc"), F.col("patch_id").cast("string"), F.lit(".py"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))
    return docs.select("patch_id", path.alias("path"), F.size("l").alias("n"), F.when(F.size(hunks) > 0, F.concat(head, F.array_join(hunks, ""))).alias("text"))


_LINES = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents))"


@query("gr8_changed_lines", f"SELECT doc_id AS patch_id, 'src/doc' || doc_id || '.py' AS path, unnest(['-', '+']) AS kind, CAST(i AS BIGINT) AS at FROM ({_LINES}) WHERE length(line) % 7 = 3")
def _(spark, d):
    from tessera.operators import patches

    found = patches.patch_lines(edited(spark, d))
    return found.select("patch_id", "path", "kind", F.coalesce("old_line", "new_line").alias("at"))


# every five lines of a document are a symbol
@query("gr8_changed_symbols", f"SELECT DISTINCT doc_id AS patch_id, 's' || ((i - 1) // 5) AS name FROM ({_LINES}) WHERE length(line) % 7 = 3")
def _(spark, d):
    from tessera.operators import patches

    own = edited(spark, d)
    k = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / 5).cast("int"))).alias("k")
    symbols = own.select("patch_id", "path", k).select("patch_id", "path", F.concat(F.lit("s"), F.col("k").cast("string")).alias("name"), (F.col("k") * 5 + 1).alias("start_line"), (F.col("k") * 5 + 5).alias("end_line"))
    return patches.changed_symbols(patches.patch_lines(own), symbols, ["patch_id"]).select("patch_id", "name")


@query("gr8_review", f"SELECT doc_id AS patch_id, CAST(1 AS BIGINT) AS files, count(*) AS added, count(*) AS removed, 'tests-not-changed' AS warnings FROM ({_LINES}) WHERE length(line) % 7 = 3 GROUP BY 1")
def _(spark, d):
    from tessera.operators import patches

    return patches.review(patches.patch_lines(edited(spark, d))).select("patch_id", "files", "added", "removed", F.array_join("warnings", ",").alias("warnings"))


def event_logs(spark, d):
    """user_id, day, text: each user's events of a day as one JSON object with an array of them."""
    e = table(spark, d, "events")
    item = F.struct("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("event_type").alias("type"), F.array(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("more"))
    logs = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("events"))
    return logs.select("user_id", "day", F.to_json(F.struct("user_id", F.struct("events").alias("log"))).alias("text"))


# what stays of each array: its first five and last four, and what failed
@query(
    "p12_bounded_json",
    """WITH o AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id)),
 k AS (SELECT user_id, day, n, event_id FROM o WHERE n <= 12 OR i <= 5 OR i > n - 4 OR event_type = 'error')
 SELECT user_id, day, string_agg(event_id, ',' ORDER BY event_id) AS kept, CAST(any_value(n) - count(*) AS BIGINT) AS omitted FROM k GROUP BY 1, 2""",
)
def _(spark, d):
    from tessera.operators.json_compaction import OMITTED, compacted

    items = F.from_json(F.get_json_object("result", "$.log.events"), f"array<struct<event_id: bigint, {OMITTED}: bigint>>")
    own = compacted(event_logs(spark, d)).select("user_id", "day", items.alias("e"))
    kept = F.filter("e", lambda x: x["event_id"].isNotNull())
    gone = F.aggregate(F.filter("e", lambda x: x[OMITTED].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x[OMITTED])
    return own.select("user_id", "day", F.array_join(F.transform(kept, lambda x: x["event_id"].cast("string")), ",").alias("kept"), gone.alias("omitted"))


@query("a6_focused_json")  # samples by words of a query: tested on planted values
def _(spark, d):
    from tessera.operators.json_compaction import compacted

    own = event_logs(spark, d).withColumn("words", F.array(F.lit("failed")))
    return compacted(own, words="words").select("user_id", "day", "result", "changed")
