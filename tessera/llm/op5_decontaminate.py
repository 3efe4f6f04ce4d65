"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and reduced to letters and digits with single spaces. An item of n characters may differ by
k = n // ``per_error`` edits. It is split into k + 1 pieces: whatever k edits do, one piece stays whole, so an Aho-Corasick
automaton over all pieces finds every place to look at, and Myers' bit-parallel edit distance over the window around each
hit decides. Items of fewer than ``per_error`` characters allow no edits and must match as whole words.

The items are read in blocks of at most ``block_chars`` characters, each block one pass with its automaton broadcast, so what
is broadcast is bounded whatever the benchmark's size.

Edge cases: null and empty texts or items match nothing; null ids are passed on; a text that holds an item several times
gives one row with the least distance, at its first end; repeated rows give their rows each; empty tables give an empty
table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces, table

_RUNS = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    return " ".join(_RUNS.findall((text or "").lower()))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the end of the first such part."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return best, end


class Matcher:
    """Items by id, with the automaton over their pieces."""

    def __init__(self, items: list[tuple[int | None, str]], per_error: int):
        self.items: list[tuple[int | None, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            norm = normalise(text)
            if not norm:
                continue
            k = len(norm) // per_error
            n = len(self.items)
            self.items.append((item_id, norm, k))
            if not k:
                pieces[f" {norm} "].append((n, -1))
                continue
            cuts = [len(norm) * i // (k + 1) for i in range(k + 2)]
            for a, z in zip(cuts, cuts[1:]):
                pieces[norm[a:z]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of each item within its error budget; places are those of the normalised text."""
        norm = normalise(text)
        if self.empty or not norm:
            return []
        padded = f" {norm} "
        places: dict[int, list[int]] = defaultdict(list)  # of an item: where it would begin in norm
        for end, (size, owners) in self.automaton.iter(padded):
            for n, offset in owners:
                places[n].append(end - size + 1 - offset - 1)
        out = []
        for n, starts in places.items():
            item_id, item, k = self.items[n]
            best: tuple[int, int, int] | None = None
            windows: list[list[int]] = []
            for s in sorted(set(starts)):
                a, z = max(0, s - k), min(len(norm), s + len(item) + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(z, windows[-1][1])
                else:
                    windows.append([a, z])
            for a, z in windows:
                part = norm[a:z]
                at = part.find(item)
                d, end = (0, at + len(item)) if at >= 0 else myers(item, part) if k else (1, 0)
                if d <= k and (best is None or d < best[0]):
                    back = myers(item[::-1], part[:end][::-1])[1] if d else len(item)
                    best = (d, a + end - back, a + end)
            if best is not None:
                out.append((item_id, *best))
        return out


@lru_cache(2)
def _matcher(items: tuple, per_error: int) -> Matcher:
    return Matcher(list(items), per_error)


def _matchers(benchmark: DataFrame, per_error: int, block_chars: int) -> Iterator[Callable[[], Matcher]]:
    """The benchmark's items (item_id, text) in blocks, each broadcast: what gives a task its matcher."""
    sized = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_chars))
    for i in range(blocks):
        own = sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i) if blocks > 1 else sized
        items = tuple(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x)))
        shared = benchmark.sparkSession.sparkContext.broadcast(items)
        yield lambda shared=shared: _matcher(shared.value, per_error)


def contaminated(docs: DataFrame, benchmark: DataFrame, per_error: int = 12, block_chars: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, distance, start_at, end_at for each document of docs (doc_id, text) and item within its error budget."""
    found = None
    for matcher in _matchers(benchmark, per_error, block_chars):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            find = matcher().find
            for b in pieces(batches):
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], names=["doc_id", "item_id", "distance", "start_at", "end_at"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, start_at long, end_at long")
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, per_error: int = 12, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of docs, all columns kept, whose ``text`` holds no item within its error budget. Each row is judged where it is: nothing is shuffled or joined."""
    for matcher in _matchers(benchmark, per_error, block_chars):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            find = matcher().find
            for b in pieces(batches):
                yield b.filter(pa.array([not find(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
