"""Typed graphs: closure with decaying confidence, impact, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import written

# Confidence of an edge kind in a closure and in an impact analysis.
CLOSURE = {"semantic-ref": 3.5, "semantic-call": 3.0, "imports": 0.95, "reexport": 0.93, "imported-by": 0.9, "calls-symbol": 0.9, "calls": 0.85}
IMPACT = {"semantic-call": 0.99, "imported-by": 0.95, "reexport": 0.9, "calls-symbol": 0.9, "imports": 0.75, "calls": 0.75}
DECAY = 0.75


def weighed(edges: DataFrame, weights: dict[str, float], other: float) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return edges.withColumn("conf", F.coalesce(table[F.col("kind")], F.lit(other)))


def closure(edges: DataFrame, seeds: DataFrame, hops: int = 2, min_confidence: float = 0.0, weights: dict[str, float] = CLOSURE) -> DataFrame:
    """path, distance, reason, source, confidence of what is reached from the seeds (path) in at most ``hops`` steps.

    Breadth first: a path keeps its first level, there the best (confidence, then source, then kind). Levels are joins on the edge's
    source with an anti-join on what was visited; the loop runs over hops, never over rows.
    """
    e = weighed(edges, weights, 0.6).select("src", "dst", "kind", "conf")
    visited = seeds.select("path").distinct()
    level, out = visited, None
    for hop in range(1, hops + 1):
        found = e.join(level.withColumnRenamed("path", "src"), "src").select(F.col("dst").alias("path"), F.lit(hop).alias("distance"), F.col("kind").alias("reason"), F.col("src").alias("source"), (F.col("conf") * DECAY ** (hop - 1)).alias("confidence"))
        found = found.where(F.col("confidence") >= min_confidence).join(visited, "path", "left_anti")
        best = found.groupBy("path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source", "reason", "distance")).alias("b"))
        found = best.select("path", F.col("b.distance").alias("distance"), F.col("b.reason").alias("reason"), F.col("b.source").alias("source"), (-F.col("b.c")).alias("confidence"))
        if hop < hops:  # a level is read three times: written, it is computed once
            found = written(found, "level")
        out = found if out is None else out.unionByName(found)
        level = found.where("reason <> 'semantic-ref'").select("path")
        visited = visited.union(found.select("path"))
    return out


def closure_by_query(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_items: int = 20, min_confidence: float = 0.5, weights: dict[str, float] = CLOSURE) -> DataFrame:
    """query_id, path, distance, reason, source, confidence: what each query reaches from its own seeds (query_id, path).

    As ``closure`` for each query, with all queries walking at once: the frontier is keyed by query and path, and each level is
    written, so that none is computed again. Of what a query reaches the first ``max_items`` stay, by distance, confidence and path,
    and only those are walked on from; the best edge into a path is that of highest confidence, then smallest source, then kind.
    """
    e = weighed(edges, weights, 0.6).select("src", "dst", "kind", "conf")
    visited = seeds.where(F.col("path").isNotNull()).select("query_id", "path").distinct()
    level, out, spent = visited, None, None
    for hop in range(1, hops + 1):
        met = level.withColumnRenamed("path", "src").join(e, "src").select("query_id", F.col("dst").alias("path"), F.lit(hop).alias("distance"), F.col("kind").alias("reason"), F.col("src").alias("source"), (F.col("conf") * DECAY ** (hop - 1)).alias("confidence"))
        met = met.where(F.col("confidence") >= min_confidence).join(visited, ["query_id", "path"], "left_anti")
        best = met.groupBy("query_id", "path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source", "reason", "distance")).alias("b"))
        found = best.select("query_id", "path", F.col("b.distance").alias("distance"), F.col("b.reason").alias("reason"), F.col("b.source").alias("source"), (-F.col("b.c")).alias("confidence"))
        if spent is not None:
            found = found.join(spent, "query_id", "left")
        left = F.lit(max_items) - (F.lit(0) if spent is None else F.coalesce("n", F.lit(0)))
        order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "path")
        # at most max_items a query leave a task, whatever the frontier meets
        found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_items).where(F.col("_r") <= left).drop("_r", "n")
        found = written(found, "level")
        out = found if out is None else out.unionByName(found)
        spent = out.groupBy("query_id").agg(F.count("*").alias("n"))
        level = found.where("reason <> 'semantic-ref'").select("query_id", "path")
        visited = visited.unionByName(found.select("query_id", "path"))
    return out


def providers_by_query(edges: DataFrame, seeds: DataFrame, weights: dict[str, float] = CLOSURE) -> DataFrame:
    """query_id, path, reason, source, distance, confidence: one-hop targets of semantic references of each query's seeds, seeds left out."""
    own = seeds.select("query_id", "path").distinct()
    refs = weighed(edges.where("kind = 'semantic-ref'"), weights, 0.6)
    met = own.withColumnRenamed("path", "src").join(refs, "src").select("query_id", F.col("dst").alias("path"), F.col("src").alias("source"), F.col("kind").alias("reason"), F.lit(1).alias("distance"), F.col("conf").alias("confidence"))
    met = met.join(own, ["query_id", "path"], "left_anti")
    best = met.groupBy("query_id", "path").agg(F.min("source").alias("source"), F.first("reason").alias("reason"), F.first("distance").alias("distance"), F.max("confidence").alias("confidence"))
    return best


def graph_credit(ranked: DataFrame, edges: DataFrame, seed_limit: int = 8, hops: int = 2, max_items: int = 20, credit: float = 2.5) -> DataFrame:
    """ranked (query_id, path, rank, score, relevant, priority) with ``graph``, what the graph adds to the score, and ``reason``.

    Seeds are each query's first relevant paths, those of priority before others. What they reach gains ``credit`` times its
    confidence; a path without such a gain that any relevant path refers to gains the same for that reference. Paths that a
    query has not ranked gain nothing.
    """
    pool = ranked.where("relevant")
    order = Window.partitionBy("query_id").orderBy(F.desc("priority"), "rank", "path")
    seeds = pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seed_limit).select("query_id", "path")
    reached = closure_by_query(edges, seeds, hops, max_items)
    told = F.concat(F.col("reason"), F.lit(":"), F.col("source").cast("string"), F.lit("@"), F.col("distance").cast("string"))
    gain = lambda df: df.select("query_id", "path", (credit * F.col("confidence")).alias("gain"), told.alias("why"))
    more = providers_by_query(edges, pool).join(reached, ["query_id", "path"], "left_anti")
    all_ = gain(reached).unionByName(gain(more))
    out = ranked.join(all_, ["query_id", "path"], "left")
    return out.select(*[F.col(c) for c in ranked.columns], F.coalesce("gain", F.lit(0.0)).alias("graph"), F.col("why").alias("reason"))


def semantic_credit(ranked: DataFrame, witnesses: DataFrame, edges: DataFrame, most: float = 10.0, credit: float = 2.5) -> DataFrame:
    """ranked (query_id, path, score) with ``graph`` and ``reason`` from the twelve best witnesses (query_id, path, rank) of each query:
    their references, or one step of at least 0.8, whichever is the surer; never more than ``most``."""
    order = Window.partitionBy("query_id").orderBy("rank", "path")
    seeds = witnesses.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 12).select("query_id", "path")
    columns = ["query_id", "path", "confidence", "reason", "source"]
    both = providers_by_query(edges, seeds).select(*columns).unionByName(closure_by_query(edges, seeds, 1, 24, 0.8).select(*columns))
    best = both.groupBy("query_id", "path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source", "reason")).alias("b"))
    gain = best.select("query_id", "path", F.least(F.lit(most), -F.col("b.c") * credit).alias("graph"), F.concat(F.col("b.reason"), F.lit(":"), F.col("b.source").cast("string")).alias("reason"))
    return ranked.join(gain, ["query_id", "path"], "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))


def neighbors(edges: DataFrame, order: tuple[str, ...] = ("imported-by", "imports", "calls-symbol", "calls")) -> DataFrame:
    """src, dst, kind: one edge a pair, of the kind that comes first in ``order``."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min_by("kind", rank).alias("kind"))


def impact(edges: DataFrame, changed: DataFrame, weights: dict[str, float] = IMPACT) -> DataFrame:
    """path, confidence: dependents of the changed paths by their best edge."""
    met = weighed(edges, weights, 0.65).join(changed.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    return met.join(changed.select(F.col("path").alias("dst")).distinct(), "dst", "left_anti").groupBy(F.col("dst").alias("path")).agg(F.max("conf").alias("confidence"))


def providers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One-hop targets of semantic references, seeds left out."""
    hop = edges.where("kind = 'semantic-ref'").join(seeds.select(F.col("path").alias("src")), "src", "left_semi")
    return hop.select(F.col("dst").alias("path")).distinct().join(seeds.select("path"), "path", "left_anti")


def package_edges(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """src, dst of repositories: a dependency's name is another's identity, letters alike."""
    own = packages.select(F.lower("identity").alias("name"), F.col("repo").alias("dst"))
    return dependencies.select(F.col("repo").alias("src"), F.lower("dependency").alias("name")).join(own, "name").where("src <> dst").select("src", "dst").distinct()


def rank_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
