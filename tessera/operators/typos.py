"""Corrections of mistyped query terms by an index over a vocabulary of any size.

A correction has the first letter of the term, a length within two, and a matching-blocks ratio of at least ``min_ratio``.
That ratio bounds how many characters of both may be left unmatched: D = la + lb - 2 M with M the least match that reaches
it. Cut into D + 1 pieces, a vocabulary term keeps one piece whole in the query term, shifted by at most D places. So both
sides are joined by equality on lengths, first letter, number and text of the piece, and the exact ratio is computed for
what meets. Of the candidates the best counts, if it is close to the term or clearly ahead of the second.

Terms are lower-cased; terms of fewer than four characters and terms of the vocabulary are not corrected; nulls are left out;
repeated terms count once; ties go to the first in code-point order.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHORTEST, FURTHEST = 4, 2


def threshold(longer: int, min_ratio: float) -> float:
    return min_ratio if longer >= 7 else max(min_ratio, 0.86)


@lru_cache(100_000)
def unmatched(a: int, b: int, min_ratio: float) -> int:
    """The most characters of two terms of these lengths that may be left unmatched; -1 if they can't be similar enough."""
    least = threshold(max(a, b), min_ratio)
    m = math.ceil(least * (a + b) / 2 - 1e-9)
    return a + b - 2 * m if m <= min(a, b) else -1


def _keys(min_ratio: float, probe: bool):
    """Arrow rows (length of the query term, length of the vocabulary's, first letter, piece number, piece, term)."""

    def of(term: str) -> Iterator[tuple]:
        n = len(term)
        for other in range(max(SHORTEST, n - FURTHEST), n + FURTHEST + 1):
            a, b = (n, other) if probe else (other, n)
            d = unmatched(a, b, min_ratio)
            if d < 0:
                continue
            cuts = [b * i // (d + 1) for i in range(d + 2)]
            for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                if not probe:
                    yield a, b, term[0], i, term[s:e]
                    continue
                for piece in {term[p : p + e - s] for p in range(max(0, s - d), min(n - (e - s), s + d) + 1)}:
                    yield a, b, term[0], i, piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*k, t) for t in batch.column(0).to_pylist() for k in of(t)]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 20_000]), (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["a", "b", "first", "i", "piece", "t"])

    return run


KEY = ["a", "b", "first", "i", "piece"]


def corrections(vocabulary: DataFrame, asked: DataFrame, min_ratio: float = 0.88, min_margin: float = 0.08) -> DataFrame:
    """term, corrected, ratio for the terms of ``asked`` (term) that have one in ``vocabulary`` (term)."""
    own = lambda df: df.select(F.lower("term").alias("term")).where(F.length("term") >= SHORTEST).distinct()
    known = own(vocabulary)
    typed = own(asked).join(known, "term", "left_anti")
    key = "a int, b int, first string, i int, piece string, t string"
    index = known.mapInArrow(_keys(min_ratio, False), key).withColumnRenamed("t", "corrected")
    probes = typed.mapInArrow(_keys(min_ratio, True), key).withColumnRenamed("t", "term")
    met = probes.join(index, KEY).select("term", "corrected").distinct()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for term, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ratio = difflib.SequenceMatcher(None, term, other).ratio()
                if ratio >= threshold(max(len(term), len(other)), min_ratio):
                    rows.append((term, other, ratio))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["term", "corrected", "ratio"])

    rated = met.mapInArrow(rate, "term string, corrected string, ratio double")
    order = Window.partitionBy("term").orderBy(F.desc("ratio"), "corrected")
    two = rated.withColumn("r", F.row_number().over(order)).where("r <= 2")  # a limit of two for each term, taken before the shuffle too
    out = two.groupBy("term").agg(F.max(F.when(F.col("r") == 1, F.col("corrected"))).alias("corrected"), F.max("ratio").alias("ratio"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("ratio"))), F.lit(0.0)).alias("second"))
    return out.where((F.col("ratio") >= 0.94) | (F.col("ratio") - F.col("second") >= min_margin)).select("term", "corrected", "ratio")


def expanded(queries: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, term, added: the terms of each query (query_id, term) once each, and corrections that it doesn't have."""
    own = queries.where(F.col("term").isNotNull()).select("query_id", "term").distinct()
    more = own.withColumn("typed", F.lower("term")).join(found.select(F.col("term").alias("typed"), "corrected"), "typed").select("query_id", F.col("corrected").alias("term")).distinct()
    more = more.join(own, ["query_id", "term"], "left_anti")
    return own.withColumn("added", F.lit(False)).unionByName(more.withColumn("added", F.lit(True)))
