"""Budgets: proportional allocation, greedy packing and cost formulas."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let


def largest_remainder(df: DataFrame, keys: list[str], name: str, weight: str, total: str, minimum: int = 0) -> DataFrame:
    """df with ``tokens``: a minimum each, the rest in proportion to the weights; what rounding leaves goes to the largest
    fractions, ties to the greater name. Groups whose weights are all 0 share alike."""
    w = Window.partitionBy(*keys)
    share = F.when(F.sum(weight).over(w) > 0, F.col(weight) / F.sum(weight).over(w)).otherwise(1.0 / F.count("*").over(w))
    own = df.withColumn("_rest", F.greatest(F.lit(0), F.col(total) - minimum * F.count("*").over(w))).withColumn("_raw", F.col("_rest") * share)
    own = own.withColumn("_floor", F.floor("_raw")).withColumn("_left", F.col("_rest") - F.sum("_floor").over(w))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 9)), F.desc(name))
    own = own.withColumn("tokens", (minimum + F.col("_floor") + (F.row_number().over(order) <= F.col("_left")).cast("int")).cast("long"))
    return own.drop("_rest", "_raw", "_floor", "_left")


def coverage_target(max_files: Column, n: Column, available: Column) -> Column:
    return F.least(max_files, n, F.floor(available / 300))


def section_budget(remaining: Column, index: Column, selected: Column, max_files: Column, n: Column, authority: Column, coverage: Column, pending: Column, pending_index: Column, pending_reserve: Column, least: int = 300) -> Column:
    """Tokens for the candidate at ``index``: three fifths of what remains for an authority, two fifths for others, ``least`` at least,
    all of it for the last one; minus what the coverage slots after it and a pending authority need."""
    share = F.greatest(F.floor(remaining * F.when(authority, 3).otherwise(2) / 5), F.lit(least))
    own = F.when((selected + 1 < max_files) & (index + 1 < n), F.least(remaining, share)).otherwise(remaining)
    slots = F.when((coverage > 0) & (index < coverage), F.greatest(F.lit(0), coverage - index - 1) * least).otherwise(0)
    covered = F.coalesce((index < pending_index) & (pending_index < coverage), F.lit(False))
    held = F.when(pending, F.when(covered, F.greatest(F.lit(0), pending_reserve - least)).otherwise(pending_reserve)).otherwise(0)
    reserve = slots + held
    return F.when(remaining <= 0, 0).when(reserve > 0, F.least(own, F.greatest(F.lit(0), remaining - reserve))).otherwise(own).cast("long")


def fit_prefix(df: DataFrame, keys: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose tokens stay within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def greedy_pack(ranked: DataFrame, keys: list[str], order: str, tokens: str, terms: str, budget: int, near: float = 0.92, max_items: int = 12) -> DataFrame:
    """Greedy selection in rank order within a token budget; an item too like one already taken is passed over.

    A sequential fold over each query's candidates, so it runs as one Arrow group a query; candidates of a query are bounded by the
    ranking before it (top-k).
    """
    import pyarrow as pa

    names = [*keys, order, tokens]

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        used, taken, rows = 0, [], []
        for i, (n, x) in enumerate(zip(t.column(tokens).to_pylist(), t.column(terms).to_pylist())):
            s = set(x or ())
            if len(rows) == max_items:
                break
            if used + n > budget or any(s and y and len(s & y) / len(s | y) >= near for y in taken):
                continue
            used += n
            taken.append(s)
            rows.append(i)
        return t.take(pa.array(rows, pa.int64())).select(names)

    from pyspark.sql import types as T

    schema = T.StructType([ranked.schema[c] for c in names])
    return ranked.groupBy(*keys).applyInArrow(fold, schema)


def rewrite_value(tokens_before: Column, tokens_after: Column, future_reads: Column, write: float = 1.25, read: float = 0.10) -> Column:
    """What a rewrite of cached context saves over its life, in token units: positive where it pays."""
    keep = tokens_before * read * future_reads
    redo = tokens_after * write + tokens_after * read * F.greatest(future_reads - 1, F.lit(0))
    return keep - redo


def visual_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# Shares of a context's components by task.
COMPONENTS = ("source", "history", "memory", "tool_results", "schemas", "reserve")
SHARES = {
    "general": (0.50, 0.15, 0.08, 0.10, 0.06, 0.11), "explanation": (0.45, 0.18, 0.10, 0.08, 0.05, 0.14), "coding": (0.60, 0.10, 0.06, 0.10, 0.05, 0.09),
    "debugging": (0.50, 0.12, 0.05, 0.20, 0.04, 0.09), "review": (0.62, 0.10, 0.05, 0.08, 0.04, 0.11), "planning": (0.45, 0.15, 0.15, 0.07, 0.04, 0.14),
}


def context_budget(total: Column, task: Column, tier: Column, high_risk: Column, observed: dict[str, Column]) -> Column:
    """A struct of tokens by component that always adds up to ``total``; null for unknown tasks.

    Shares of the task, moved by complexity and risk, are rounded by largest remainders (ties: the greater name). A component with
    an observed demand is cut to it; what that frees goes to the source as far as its demand is unknown or larger, the rest to the
    reserve. A null demand is unknown.
    """
    hard = F.when(tier == "complex", 1.10).when(tier == "extended", 1.18)
    table = F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    moved = {"source": F.coalesce(hard, F.lit(1.0)) * F.when(high_risk, 1.08).otherwise(1.0), "history": F.when(hard.isNotNull(), 1.06).otherwise(1.0), "schemas": F.when(hard.isNotNull(), 0.94).otherwise(1.0), "reserve": F.when(high_risk, 1.20).otherwise(1.0), "memory": F.when(high_risk, 0.92).otherwise(1.0)}
    raw = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("i"), (table[task][i] * moved.get(c, F.lit(1.0))).alias("w")) for i, c in enumerate(COMPONENTS)])
    whole = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x["w"])
    parts = let(whole, lambda n: F.transform(raw, lambda x: F.struct(x["i"].alias("i"), x["name"].alias("name"), F.floor(total * (x["w"] / n)).alias("low"), (total * (x["w"] / n) - F.floor(total * (x["w"] / n))).alias("rest"))))
    left = lambda p: total - F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["low"])
    order = lambda p: F.reverse(F.array_sort(F.transform(p, lambda x: F.struct(F.round(x["rest"], 9).alias("rest"), x["name"].alias("name"), x["i"].alias("i"), x["low"].alias("low")))))
    given = let(parts, lambda p: let(order(p), lambda o: F.transform(F.sequence(F.lit(0), F.lit(len(COMPONENTS) - 1)), lambda k: F.struct(F.get(o, k)["name"].alias("name"), (F.get(o, k)["low"] + (k < left(p)).cast("int")).alias("n")))))

    def shared(g: Column) -> Column:
        of = F.map_from_arrays(F.transform(g, lambda x: x["name"]), F.transform(g, lambda x: x["n"]))
        want = {c: observed.get(c, F.lit(None)).cast("long") for c in COMPONENTS[:5]}
        cut = {c: F.coalesce(F.least(of[c], want[c]), of[c]) for c in want}
        freed = sum((of[c] - cut[c] for c in want), F.lit(0))
        to_source = F.when(want["source"].isNull(), freed).otherwise(F.least(freed, F.greatest(F.lit(0), want["source"] - cut["source"])))
        out = cut | {"source": cut["source"] + to_source, "reserve": of["reserve"] + freed - to_source}
        return F.struct(*[out[c].cast("long").alias(c) for c in COMPONENTS])

    return F.when(task.isin(*SHARES), let(given, shared))
