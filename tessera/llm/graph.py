"""Connected components of an edge table: contraction within tasks, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, scratch

#: Edges (16 bytes each) that a task contracts at a time.
BLOCK = 1_000_000


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes and for each the smallest node reachable, by hooking roots and halving paths."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(label, nearer := label[label]):
            label = nearer


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars (hi: a node, lo: the smallest node that it reaches within its block of edges); never more edges than came in."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        nodes, low = labels_of(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))
        held.clear()
        own = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(low[own])], names=["hi", "lo"])

    n = 0
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
        if n >= BLOCK:
            yield out()
            n = 0
    if held:
        yield out()


def _settled(e: DataFrame) -> bool:
    """Whether every edge ends in a node of no smaller neighbour and no node has two edges down: two partial aggregations."""
    seen = e.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("lo", F.lit(0), F.lit(1)))
    bad = seen.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)")
    return bad.isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 50) -> DataFrame:
    """(node, comp) for each node of ``edges``, comp the smallest node reachable.

    Tasks first contract the edges they hold. Each round is then two partial aggregations and two equi-joins, which adaptive
    execution can split, over a table written to the shared folder; edges never leave the executors, and their number never grows.
    The count of rounds follows the logarithm of the longest path left. Loops and nulls are ignored.
    """
    with scratch(edges.sparkSession):
        plain = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
        e = materialise(plain.mapInArrow(_contracted, "hi long, lo long"), "cc")
        for _ in range(rounds):
            if _settled(e):
                break
            both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
            low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
            large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).mapInArrow(_contracted, "hi long, lo long"), "cc")
            low = large.groupBy("hi").agg(F.min("lo").alias("m"))
            small = large.join(low, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low).distinct()
            e = materialise(small.mapInArrow(_contracted, "hi long, lo long"), "cc")
        else:
            raise RuntimeError("components did not settle")
        found = e.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        return materialise(found.union(found.select("comp", "comp").distinct()), "components", result=True)
