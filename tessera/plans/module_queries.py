"""Queries of source files: references of modules and typed edges, over a source text for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.sources.tables import dealt, parts, written


def supplier_sources(spark, d):
    """path, text, symbols, calls, imports: a file for each supplier that takes a name of file ``part % 25 + 1`` for each kind of line it sold."""
    lines = table(spark, d, "lineitem")
    sold = lines.select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 25 + 1).alias("t"), (F.col("l_linenumber") % 3).alias("k")).distinct()
    name, module = F.concat_ws("_", F.concat(F.lit("v"), "t"), "k"), F.concat(F.lit("./s"), "t")
    line = F.when(F.col("k") == 2, F.concat(F.lit("export { "), name, F.lit(" } from '"), module, F.lit("'")))
    line = line.otherwise(F.concat(F.lit("import { "), name, F.lit(" } from '"), module, F.lit("'\n"), name, F.when(F.col("k") == 0, "()").otherwise(";")))
    texts = dealt(sold, parts(lines), "s").groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"), F.collect_set(F.when(F.col("k") != 2, module)).alias("imports"))
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s")).join(texts, "s", "left")
    return own.select(
        F.concat(F.lit("s"), "s", F.lit(".ts")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.concat(F.lit("f"), "s")).alias("symbols"),
        F.array(F.concat(F.lit("x.F"), F.col("s") + 1)).alias("calls"), "imports",
    )


_SOLD = "sold AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 25 + 1 AS t, l_linenumber % 3 AS k FROM lineitem)"


@query("gr6_module_refs", f"WITH {_SOLD} SELECT 's' || s || '.ts' AS src, './s' || t AS module, 'v' || t || '_' || k AS symbol, CASE k WHEN 0 THEN 'semantic-call' WHEN 1 THEN 'semantic-ref' ELSE 'reexport' END AS kind FROM sold JOIN supplier ON s = s_suppkey")
def _(spark, d):
    from tessera.operators.modules import module_refs

    return module_refs(supplier_sources(spark, d).withColumnRenamed("path", "src")).drop("local")


_J6 = f"""WITH {_SOLD}, f AS (SELECT DISTINCT s_suppkey AS s FROM supplier), l AS (SELECT sold.* FROM sold WHERE s IN (SELECT s FROM f) AND t IN (SELECT s FROM f)),
 e AS (SELECT s AS a, t AS b, min(k) + 1 AS r FROM l GROUP BY 1, 2 UNION ALL SELECT t, s, 4 FROM l WHERE k <> 2 UNION ALL SELECT s, t, 5 FROM l WHERE k <> 2
  UNION ALL SELECT s + 1, s, 6 FROM f WHERE s + 1 IN (SELECT s FROM f) UNION ALL SELECT s, s + 1, 7 FROM f WHERE s + 1 IN (SELECT s FROM f))
 SELECT 's' || a || '.ts' AS src, 's' || b || '.ts' AS dst, CASE min(r) WHEN 1 THEN 'semantic-call' WHEN 2 THEN 'semantic-ref' WHEN 3 THEN 'reexport' WHEN 4 THEN 'imported-by' WHEN 5 THEN 'imports' WHEN 6 THEN 'calls-symbol' ELSE 'calls' END AS kind
 FROM e WHERE a <> b GROUP BY a, b"""


@query("j6_typed_edges", _J6)
def _(spark, d):
    from tessera.operators.modules import module_refs, typed_edges

    files = written(supplier_sources(spark, d), "files")  # read for the references, the paths and the keys of both joins
    refs = written(module_refs(files.withColumnRenamed("path", "src")), "refs")
    return typed_edges(files, refs, parts(refs))
