"""Statistics of paired experiments, holdouts and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded_index_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Percentile as the value at index round((n - 1) q), halves to even: ranks by a window, so no group is held in memory."""
    own = df.where(F.col(value).isNotNull())
    sizes = own.groupBy(*keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = own.select(*keys, value, (F.row_number().over(w) - 1).alias("_i")).join(sizes, keys)
    return ranked.groupBy(*keys).agg(*[F.round(F.max(F.when(F.col("_i") == F.bround((F.col("_n") - 1) * q).cast("long"), F.col(value))), 6).alias(name) for name, q in wanted.items()])


def summary(df: DataFrame, keys: list[str], success: str, cost: str, latency: str) -> DataFrame:
    """runs, successes, success_rate, cost (null unless every run is priced), cost_per_success, mean and median latency."""
    total = F.when(F.count(cost) == F.count("*"), F.sum(cost))
    wins = F.count_if(F.col(success))
    return df.groupBy(*keys).agg(
        F.count("*").alias("runs"), wins.alias("successes"), F.round(wins / F.count("*"), 6).alias("success_rate"), F.round(total, 4).alias("cost"),
        F.round(F.try_divide(total, F.nullif(wins, F.lit(0))), 4).alias("cost_per_success"), F.round(F.avg(latency), 4).alias("mean_latency"), F.round(F.percentile(latency, F.lit(0.5)), 4).alias("median_latency"),
    )


def paired(df: DataFrame, keys: list[str], arm: str, base: str, other: str, value: str) -> DataFrame:
    """keys, base value, other value of pairs that have both arms: one aggregation instead of a self-join."""
    out = df.groupBy(*keys).agg(F.max(F.when(F.col(arm) == base, F.col(value))).alias("base"), F.max(F.when(F.col(arm) == other, F.col(value))).alias("other"))
    return out.where("base is not null and other is not null")


def arm_of(experiment: str, unit: Column, rate: float) -> Column:
    """'control' where the first 8 bytes of sha256(experiment:unit), over 2**64, are below the rate."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{experiment}:"), unit), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)
    return F.when(share < rate, "control").otherwise("treatment")


def stratified_reduction(df: DataFrame, strata: list[str], unit: str, arm: str, value: str, least: int = 3) -> DataFrame:
    """Per stratum: means over units of each arm, weight min(n_control, n_treatment), and 1 - treatment / control.

    First a mean for each unit, then for each stratum; strata with under ``least`` units in an arm are left out.
    """
    units = df.groupBy(*strata, unit, arm).agg(F.avg(value).alias("m"))
    side = lambda a: F.when(F.col(arm) == a, F.col("m"))
    out = units.groupBy(*strata).agg(F.count(side("control")).alias("n_control"), F.count(side("treatment")).alias("n_treatment"), F.avg(side("control")).alias("control"), F.avg(side("treatment")).alias("treatment"))
    out = out.where((F.col("n_control") >= least) & (F.col("n_treatment") >= least) & (F.col("control") > 0))
    return out.withColumn("weight", F.least("n_control", "n_treatment")).withColumn("reduction", 1 - F.col("treatment") / F.col("control"))


def cluster_bootstrap(totals: DataFrame, cluster: str, numerator: str, denominator: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """point, low, high, defined: a ratio of sums and its 95 % interval, clusters resampled with Poisson(1) weights.

    Weights come from a hash of seed, replicate and cluster, so a replicate is the same wherever it is computed. The replicates of
    a cluster are an array, summed by position: the shuffle is replicates times tasks, not replicates times clusters.
    """
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), i, F.col(cluster)), F.lit(1 << 53)) / float(1 << 53)
    # cumulative probabilities of Poisson(1), by rule
    import math

    cuts, p, acc = [], math.exp(-1), 0.0
    for k in range(10):
        acc += p
        cuts.append(acc)
        p /= k + 1
    weight = lambda x: sum(((x >= c).cast("int") for c in cuts[1:]), (x >= cuts[0]).cast("int"))
    reps_of = totals.select(F.col(numerator).alias("a"), F.col(denominator).alias("b"), cluster).select("a", "b", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda i: weight(u(i)))).alias("rep", "w"))
    sums = reps_of.groupBy("rep").agg(F.sum(F.col("a") * F.col("w")).alias("a"), F.sum(F.col("b") * F.col("w")).alias("b"))
    ratios = sums.select(F.try_divide("a", F.nullif("b", F.lit(0))).alias("r")).where("r is not null")
    spread = ratios.agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count("*").alias("defined"))
    point = totals.agg(F.try_divide(F.sum(numerator), F.nullif(F.sum(denominator), F.lit(0))).alias("point"))
    return point.join(F.broadcast(spread)).select("point", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "defined")


def reduction_intervals(pairs: DataFrame, cluster: str, metrics: dict[str, tuple[str, str, str, str]], reps: int = 2000, seed: int = 0) -> DataFrame:
    """metric, point, low, high, clusters: 1 - (other / its count) / (base / its count) with a 95 % interval over whole clusters.

    metrics: name to columns (base sum, base count, other sum, other count), summed here by cluster first. Clusters get Poisson(1)
    weights from a hash, as in ``cluster_bootstrap``, the same for all metrics. An interval is null under two clusters or where
    fewer than 90 % of the replicates have a value.
    """
    names = sorted({c for columns in metrics.values() for c in columns})
    own = pairs.groupBy(cluster).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in names])
    drawn = own.select(*names, cluster, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep"))
    u = F.pmod(F.xxhash64(F.lit(seed), "_rep", F.col(cluster)), F.lit(1 << 53)) / float(1 << 53)
    weighed = drawn.select("_rep", *names, poisson_weight(u).alias("_w")).where("_w > 0")
    sums = weighed.groupBy("_rep").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names])

    def reduction(a: str, n: str, b: str, m: str) -> Column:
        before = F.try_divide(F.col(a), F.nullif(F.col(n), F.lit(0.0)))
        return 1 - F.try_divide(F.try_divide(F.col(b), F.nullif(F.col(m), F.lit(0.0))), F.nullif(before, F.lit(0.0)))

    told = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), reduction(*v).alias("r")) for k, v in metrics.items()])))
    spread = told(sums).groupBy("metric").agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count("r").alias("defined"))
    total = own.agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("clusters"))
    points = total.select("clusters", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), reduction(*v).alias("point")) for k, v in metrics.items()])))
    sure = (F.col("clusters") >= 2) & (F.col("defined") >= 0.9 * reps)
    out = points.join(F.broadcast(spread), "metric", "left")  # a row a metric
    return out.select("metric", "point", F.when(sure, F.col("p")[0]).alias("low"), F.when(sure, F.col("p")[1]).alias("high"), "clusters")


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) quantile of a number from 0 to 1, up to ten, by its cumulative probabilities."""
    import math

    cuts = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]
    return sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))


def quality_kept(base: dict[str, Column], other: dict[str, Column], tolerance: float = 0.1) -> Column:
    """Whether the other run of a pair keeps the quality: null without grades of both, false unless both succeed.

    Keys: success, blocker (boolean), correctness, safety, weighted.
    """
    grades = ("correctness", "safety", "weighted")
    graded = lambda run: run["correctness"].isNotNull() & run["safety"].isNotNull() & run["weighted"].isNotNull()
    level = lambda run: F.coalesce(run["blocker"], F.lit(False)).cast("int")
    kept = base["success"] & other["success"] & (level(other) <= level(base))
    for g in grades:
        kept = kept & (other[g] >= base[g] - tolerance)
    return F.when(graded(base) & graded(other), kept)


def failed_gates(gates: dict[str, Column]) -> Column:
    """The names of the gates that do not hold, in their order; a gate without a value does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in gates.items()]))
