"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits. DataFrame functions only.

Each five-word shingle is hashed once; the top 8 bits of the hash are its bin, and a bin keeps its least hash. An empty bin
takes the value of another bin: its attempts visit bins in an order of its own until one is full (first by a universal hash of
bin and attempt, then, where eight attempts failed, all full bins in the order of a hash of both bins, which ends at the first).
Of each bin's value 4 bits are kept, drawn by a hash with the bin's number so that copies of one value agree or
differ independently. Two fingerprints agree in a share R = J + (1 - J) / 16 of bins, so likeness is (R - 1/16) / (15/16).

Edge cases: null counts as empty; a text without words has the fingerprint '' and likeness 1 to another such text, 0 to any
other; texts of one to four words have one shingle; equal texts have equal fingerprints; rows of equal doc_id are ordered
by text; null ids come last; with a single row the next document is itself; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, words

BINS, BITS, SHINGLE, ATTEMPTS = 256, 4, 5, 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _probe(attempt: int, b: Column) -> Column:
    """The bin that an attempt of an empty bin visits: an odd multiple and an offset, both from a fixed mixing rule."""
    seed = (attempt * 0x9E3779B1) & 0xFFFFFFFF
    return (b * ((seed >> 8) % BINS | 1) + (seed >> 20) % BINS).bitwiseAND(BINS - 1)


def shingle_hashes(text: Column) -> Column:
    """A hash of each five-word shingle, in order."""

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(many)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _bins(hashes: Column) -> Column:
    """The least hash of each bin, null where a bin is empty; the bin is the top byte."""
    top = lambda x: F.shiftright(x, 56).cast("int")  # noqa: E731  -128 to 127
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (top(x) != top(F.get(a, i - 1))))

    def dense(a: Column) -> Column:
        gap = lambda x, i: top(x) - F.when(i == 0, F.lit(-BINS // 2 - 1)).otherwise(top(F.get(a, i - 1))) - 1
        nulls = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
        filled = F.flatten(F.transform(a, lambda x, i: F.concat(nulls(gap(x, i)), F.array(x))))
        return F.concat(filled, nulls(F.lit(BINS // 2 - 1) - top(F.element_at(a, -1))))

    return let(let(F.sort_array(hashes), first), dense)


def _values(bins: Column) -> Column:
    """Every bin's 4 bits after densification."""

    def of(d: Column, full: Column) -> Column:
        def value(x: Column, b: Column) -> Column:
            tried = [F.get(d, _probe(j, b)) for j in range(1, ATTEMPTS + 1)]
            rest = F.array_min(F.transform(full, lambda f: F.struct(F.xxhash64(b, f).alias("o"), f.alias("f"))))["f"]
            return F.xxhash64(F.coalesce(x, *tried, F.get(d, rest)), b).bitwiseAND((1 << BITS) - 1).cast("int")

        return F.transform(d, value)

    full = lambda d: F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(d, i).isNotNull())
    return let(bins, lambda d: let(full(d), lambda f: of(d, f)))


def fingerprint(text: Column) -> Column:
    """256 hexadecimal digits, one a bin; '' for a text without words."""
    digits = F.array(*[F.lit(c) for c in "0123456789abcdef"])
    packed = lambda h: F.array_join(F.transform(_values(_bins(h)), lambda v: F.get(digits, v)), "")
    return let(shingle_hashes(text), lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(packed(h)))


def likeness(a: Column, b: Column) -> Column:
    """The estimate of the similarity of two texts from their fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e)) / float(BINS)
    low = 1.0 / (1 << BITS)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (equal - low) / (1 - low)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``fingerprint``, and of the next document in ascending doc_id ``next_text`` and ``next_fingerprint``.

    Ids are cut into ranges of about equal counts at approximate quantiles, four for each of the session's shuffle partitions, a
    window leads within each range, and the first document of every range is put behind the last one of the range before.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(20_000, 8 * parts))).first()[0] or ()))
    step = max(1, int(len(cuts) ** 0.5))  # first the block of cuts, then the cut in it
    whole = lambda xs: F.array(*[F.lit(c) for c in xs]).cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    block = below(whole(cuts[::step])) - 1
    inside = let(block, lambda k: F.when(k < 0, 0).otherwise(k * step + below(F.get(F.array(*[whole(cuts[i : i + step]) for i in range(0, len(cuts), step)]), k))))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(inside if cuts else F.lit(0))
    placed = docs.withColumn("part", place.cast("int"))
    firsts = sorted((tuple(r) for r in placed.groupBy("part").agg(F.min("doc_id")).collect()))  # a row a range
    if not firsts:
        before = []
    else:
        before = [(p, firsts[i - 1][0], i) for i, (p, _) in enumerate(firsts)]
    ids = spark.createDataFrame([(p, d) for p, d in firsts], "p int, d bigint")
    heads = placed.join(F.broadcast(ids), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    heads = heads.groupBy("part").agg(F.min("text").alias("text"))
    heads = heads.join(F.broadcast(spark.createDataFrame(before, "part int, ahead int, i int")), "part").select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("ahead").alias("part"), F.lit(1).alias("head"))
    rows = placed.withColumn("head", F.lit(0)).unionByName(heads).withColumn("fingerprint", fingerprint(F.col("text")))
    w = Window.partitionBy("part").orderBy("head", F.col("doc_id").asc_nulls_last(), "text")
    led = rows.select("doc_id", "text", "head", "fingerprint", F.lead("text").over(w).alias("next_text"), F.lead("fingerprint").over(w).alias("next_fingerprint"))
    return led.where("head = 0").drop("head")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    return rows.withColumns(near).drop("next_fingerprint")
