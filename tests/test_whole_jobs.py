"""Queries over whole tables, against brute force or SQL of their own."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions.text import terms
from tessera.plans.catalogue import QUERIES


def rows_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def scores(spark, sf):
    """BM25 of every document for every benchmark item, term by term."""
    counts = {r["doc_id"]: collections.Counter(r["t"]) for r in rows_of(spark, sf, "documents").select("doc_id", terms(F.col("text")).alias("t")).collect()}
    counts = {i: c for i, c in counts.items() if c}
    size = {i: sum(c.values()) for i, c in counts.items()}
    mean = max(1.0, sum(size.values()) / len(size))
    df = collections.Counter(t for c in counts.values() for t in c)
    out = {}
    for r in rows_of(spark, sf, "benchmark").select("item_id", terms(F.col("text")).alias("t")).collect():
        for i, c in counts.items():
            met = [t for t in set(r["t"]) if t in c]
            if met:
                s = sum(math.log(1 + (len(size) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for t in met)
                out[r["item_id"], i] = (s, sum(c[t] for t in met))
    return out


def test_bm25_asks_every_item(spark, sf, scores):
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["matched"]) for r in QUERIES["r1_bm25_all"](spark, sf).collect()}
    assert got.keys() == scores.keys()
    assert all(abs(got[k][0] - scores[k][0]) < 2e-6 and got[k][1] == scores[k][1] for k in got)
    assert {r["query_id"] for r in __spark_entry__.entry(spark).select("query_id").distinct().collect()} == {q for q, _ in scores}


def test_top_documents_and_packs_of_every_item(spark, sf, scores):
    items = {q for q, _ in scores}
    top = collections.defaultdict(list)
    for r in QUERIES["r7_top_documents_all"](spark, sf).collect():
        top[r["query_id"]].append((r["rank"], r["doc_id"]))
    assert set(top) == items
    for q, found in top.items():
        own = sorted((s for (i, _), (s, _) in scores.items() if i == q), reverse=True)[:12]
        assert [n for n, _ in sorted(found)] == list(range(1, len(own) + 1))
        assert all(abs(scores[q, i][0] - s) < 2e-4 for (_, i), s in zip(sorted(found), own))
    packs = collections.defaultdict(list)
    for r in QUERIES["b1_context_pack"](spark, sf).collect():
        packs[r["query_id"]].append(r)
    assert set(packs) == items
    assert all(sum(r["tokens"] for r in p) <= 6000 and len(p) <= 12 for p in packs.values())


def test_trivial_baseline_asks_every_item(spark, sf):
    split = lambda t: {w.lower() for w in t.split(" ")}
    docs = [(r["doc_id"], split(r["text"])) for r in rows_of(spark, sf, "documents").collect() if r["text"] is not None]
    want = set()
    for r in rows_of(spark, sf, "benchmark").collect():
        met = sorted((-len(split(r["text"]) & w), i) for i, w in docs)
        want |= {(r["item_id"], i, -n) for n, i in met[:5] if n}
    assert {tuple(r) for r in QUERIES["g18_trivial_baseline_all"](spark, sf).collect()} == want


def test_eligible_brands_of_every_order(spark, sf):
    caps = {}
    for r in rows_of(spark, sf, "part").collect():
        caps[r["p_brand"]] = max(r["p_size"], caps.get(r["p_brand"], r["p_size"]))
    want = collections.Counter((r["o_orderkey"], b) for r in rows_of(spark, sf, "orders").collect() for b, cap in caps.items() if cap >= r["o_custkey"] % 60)
    assert collections.Counter(tuple(r) for r in QUERIES["f10_eligible_all"](spark, sf).collect()) == want


def test_redaction_reads_the_whole_text(spark, tmp_path):
    texts = ["token=" + "x" * 390 + " and " + "tail " * 100, "a" * 300 + " password=" + "y" * 200 + " end"]
    spark.createDataFrame(list(zip((3, 7), texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = ["token=<redacted> and " + "tail " * 100, "a" * 300 + " password=<redacted> end"]
    got = {r["doc_id"]: r["md5"] for r in QUERIES["t12_redact_command"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(t[:320].encode()).hexdigest() for i, t in zip((3, 7), want)}
