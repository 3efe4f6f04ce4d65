"""Module references of source files, found in their text, resolved against known paths, and joined to typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import dealt

# Forms of imports, re-exports and uses; the clause is the first group, the module's name the second.
NAMED_IMPORT = r"(?Us)\bimport\s+(?:type\s+)?\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]"
DEFAULT_IMPORT = r"(?Us)\bimport\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,\s*\{[^}]*\})?\s+from\s+['\"]([^'\"]+)['\"]"
NAMESPACE_IMPORT = r"(?U)\bimport\s+\*\s+as\s+([A-Za-z_$][\w$]*)\s+from\s+['\"]([^'\"]+)['\"]"
NAMED_EXPORT = r"(?Us)\bexport\s+(?:type\s+)?\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]"
STAR_EXPORT = r"(?U)\bexport\s+(\*)\s+from\s+['\"]([^'\"]+)['\"]"
REQUIRED = r"(?Us)\b(?:const|let|var)\s+\{([^}]+)\}\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
CALL = r"(?U)\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("
MEMBER = r"(?U)\b([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)\b"
NAME = r"(?U)^[A-Za-z_$][\w$]*$"
#: Kinds of edges, the surest first.
KINDS = ("semantic-call", "semantic-ref", "reexport", "imported-by", "imports", "calls-symbol", "calls")

# What a module's name may lack, in the order of preference.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
# Fixed value: slices of the sources that import the same module.
SLICES = 8


def plain_path(path: Column) -> Column:
    """A path without empty and '.' parts, each '..' taking away the part before it; above the root it takes nothing."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.expr("array()").cast("array<string>")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, none, lambda a, p: F.when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))), "/")


def _with_base(refs: DataFrame) -> DataFrame:
    """References by a relative name, with ``_base``, the path it stands for without its ending."""
    folder = F.when(F.instr("src", "/") > 0, F.regexp_replace("src", "/[^/]*$", "")).otherwise("")
    return refs.where(F.col("module").startswith(".")).withColumn("_base", plain_path(F.concat_ws("/", folder, "module")))


def _known(paths: DataFrame) -> DataFrame:
    """_base, path: each known path under as many bases as it has endings (three at most); of a base's paths the first by preference."""
    path, tails = F.col("path"), [*ENDINGS, *["/index" + e for e in ENDINGS[1:]]]
    bases = F.array_compact(F.array(*[F.when(path.endswith(e), F.struct(F.left(path, F.length(path) - len(e)).alias("_base"), F.lit(i).alias("_i"))) for i, e in enumerate(tails)]))
    return paths.select("path", F.explode(bases).alias("b")).select("b._base", "b._i", "path").groupBy("_base").agg(F.min_by("path", "_i").alias("path"))


def resolve_modules(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """src, module, path: the known path a relative module name stands for; names without one are left out.

    refs: src, module; paths: path. A name is joined once, by its base, and the base's path that comes first by preference stays.
    """
    own = _with_base(refs.select("src", "module"))
    # rows of one name share its base, so they are together already when they are made distinct
    return own.join(_known(paths), "_base").groupBy("_base", "src", "module").agg(F.first("path").alias("path")).drop("_base")


def _found(text: Column, pattern: str) -> Column:
    """clause, module of each match."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("clause"), F.regexp_extract(m, pattern, 2).alias("module")))


def _bound(clause: Column) -> Column:
    """symbol, local of each binding in a clause in braces; what isn't a name, or a name for a name, is left out."""
    parts = F.transform(F.split(clause, ","), lambda p: F.split(F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"(?U)^type\s+", ""), r"(?U)\s+as\s+|\s*:\s*", 2))
    pairs = F.transform(parts, lambda b: F.struct(b[0].alias("symbol"), F.coalesce(F.get(b, F.lit(1)), b[0]).alias("local")))
    return F.filter(pairs, lambda b: b["symbol"].rlike(NAME) & b["local"].rlike(NAME))


def _ref(module: Column, symbol: Column, local: Column, kind: Column) -> Column:
    return F.struct(module.alias("module"), symbol.alias("symbol"), local.alias("local"), kind.alias("kind"))


def module_refs(sources: DataFrame) -> DataFrame:
    """src, module, symbol, local, kind: what each source (src, text) takes from other modules, each reference once.

    An imported name counts if it is called (semantic-call) or met a second time (semantic-ref); of a namespace its members count;
    re-exports always do. A null or empty text has none. All matching stays in the row; only the references leave it.
    """
    text, calls = F.col("text"), F.col("calls")
    own = sources.select("src", "text").withColumn("calls", F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))))
    own = own.withColumn("bare", F.transform("calls", lambda c: F.element_at(F.split(c, r"\."), -1)))
    seen_again = lambda name: F.regexp_count(text, F.concat(F.lit(r"(?U)\b"), F.regexp_replace(name, r"\$", r"\\\$"), F.lit(r"\b"))) > 1
    called = lambda name: F.array_contains(F.col("bare"), name)
    kind = lambda yes: F.when(yes, "semantic-call").otherwise("semantic-ref")
    used = lambda refs: F.filter(refs, lambda r: (r["kind"] == "semantic-call") | seen_again(r["local"]))
    each = lambda pattern, make: F.flatten(F.transform(_found(text, pattern), lambda m: F.transform(_bound(m["clause"]), lambda b: make(m, b))))
    named = lambda pattern: used(each(pattern, lambda m, b: _ref(m["module"], b["symbol"], b["local"], kind(called(b["local"])))))
    default = used(F.transform(_found(text, DEFAULT_IMPORT), lambda m: _ref(m["module"], F.lit("default"), m["clause"], kind(called(m["clause"])))))
    members = F.array_distinct(F.regexp_extract_all("text", F.lit(MEMBER), F.lit(0)))
    of_space = lambda m: F.filter(members, lambda x: F.split(x, r"\.")[0] == m["clause"])
    space_called = lambda x: F.exists(calls, lambda c: (c == x) | c.startswith(F.concat(x, F.lit("."))))
    spaces = F.flatten(F.transform(_found(text, NAMESPACE_IMPORT), lambda m: F.transform(of_space(m), lambda x: _ref(m["module"], F.split(x, r"\.")[1], x, kind(space_called(x))))))
    exported = each(NAMED_EXPORT, lambda m, b: _ref(m["module"], b["symbol"], b["local"], F.lit("reexport")))
    stars = F.transform(_found(text, STAR_EXPORT), lambda m: _ref(m["module"], F.lit("*"), F.lit("*"), F.lit("reexport")))
    refs = F.array_distinct(F.concat(named(NAMED_IMPORT), default, spaces, named(REQUIRED), exported, stars))
    return own.select("src", F.explode(refs).alias("r")).select("src", "r.*")


def _last(value: Column, mark: str) -> Column:
    return F.element_at(F.split(value, mark), -1)


def _import_keys(value: Column) -> Column:
    """The last part of an import's path in lower case, and what stands behind its last dot."""
    name = F.lower(_last(F.regexp_replace(value, r"(/\.?)+$", ""), "/"))
    return F.array(name, _last(name, r"\."))


def _met(many: DataFrame, one: DataFrame, key: str, by: str, parts: int | None) -> DataFrame:
    """Rows of ``many`` with those of ``one`` that share their key.

    A module that most sources import is a key of most rows: a key's rows are cut by ``by`` into slices, each with its own copy of ``one``.
    """
    many = many.withColumn("_slice", F.pmod(F.xxhash64(by), F.lit(SLICES)).cast("int"))
    one = one.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return dealt(many, parts, key, "_slice").join(dealt(one, parts, key, "_slice"), [key, "_slice"]).drop("_slice")


def typed_edges(files: DataFrame, refs: DataFrame, parts: int | None = None) -> DataFrame:
    """src, dst, kind: for each file its neighbours, each by its surest kind in the order of KINDS.

    files: path and arrays symbols, calls, imports; refs as ``module_refs`` gives them. A file's stem is joined with what others import, and
    its symbols with what others call: two equi-joins, read in both directions. References resolved to a known path win over both; of
    several kinds to one path a call does, then the first in order. References are reduced to one for each name in a source before
    they are resolved, and edges to one for each pair, over ``parts`` partitions (else the session's number).
    """
    stem = F.lower(F.regexp_replace(_last(F.col("path"), "/"), r"(?<=.)\.[^.]+$", ""))
    keys = lambda name, key: files.select(F.col("path").alias(name), F.explode(F.array_distinct(key)).alias("key")).where("key <> ''")
    importers = keys("a", F.flatten(F.transform("imports", _import_keys)))
    callers = keys("a", F.transform("calls", lambda c: F.lower(_last(c, r"\."))))
    way = lambda src, dst, kind: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"))
    ways = lambda to, back: F.inline(F.array(way("a", "b", to), way("b", "a", back)))
    plain = _met(importers, keys("b", F.array(stem)).distinct(), "key", "a", parts).select(ways("imports", "imported-by"))
    plain = plain.unionByName(callers.join(keys("b", F.transform("symbols", F.lower)).distinct(), "key").select(ways("calls", "calls-symbol")))
    first = F.struct((F.col("kind") != "semantic-call").alias("later"), "module", "symbol", "local", "kind")
    named = _with_base(dealt(refs, parts, "src").groupBy("src", "module").agg(F.min(first).alias("first")))
    semantic = _met(named, _known(files), "_base", "src", parts).select("src", F.col("path").alias("dst"), F.lit(-1).alias("rank"), "first.*")
    edges = plain.unionByName(semantic, allowMissingColumns=True).where("src <> dst")
    return dealt(edges, parts, "src", "dst").groupBy("src", "dst").agg(F.min(F.struct("rank", "later", "module", "symbol", "local", "kind"))["kind"].alias("kind"))
