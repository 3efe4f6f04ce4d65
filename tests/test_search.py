"""Kept indexes: approximate vectors, ranked full text, typing errors."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, typos
from tessera.operators.vectors import exact_top_k
from tessera.plans.catalogue import QUERIES


def test_recall_on_the_table(spark):
    r = QUERIES["l3_ann_recall"](spark, "/root/testdata/sf0.01").first()
    print(r)
    assert r["recall"] >= 0.9 and r["n_exact"] == 10 * r["n_queries"]


def test_clusters_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(1500)]  # a third of all rows are copies
    rows += [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [1.0] * 5), (9004, [float("nan")] * 24), (None, rows[9][1]), (11, rows[11][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(vectors)
    assert index.blocks.selectExpr("sum(size(ids))").first()[0] == 3000 + 1500 + 2
    assert index.probes < len(index.centroids) / 2  # clusters need few lists
    asked = vectors.where("vec_id % 50 = 0 or vec_id >= 9000").selectExpr("vec_id query_id", "embedding q")
    got = ann.search(index, asked, 10)
    assert got.where("query_id >= 9001 and query_id <= 9004").count() == 0
    assert ann.recall(got, exact_top_k(vectors.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding q"), vectors.where("vec_id is not null").dropDuplicates(["vec_id"]), 10).withColumnRenamed("vec_id", "id")).first()["recall"] >= 0.9
    best = {r["query_id"]: r["score"] for r in got.where("rank = 1").collect()}
    assert best[0] == 1.0 and all(r["rank"] <= 10 for r in got.collect())
    assert ann.search(ann.build(vectors.where("false"), dim=24), asked, 3).count() == 0
    assert ann.search(index, asked.where("false"), 3).count() == 0


@pytest.mark.parametrize("k", [1, 7])
def test_exact_keeps_all_that_tie(spark, k):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, q array<double>"), vectors, k).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(60) if i % 3 == 1][:k]


def brute_corrections(vocabulary, asked, min_ratio, margin):
    known = {v.lower() for v in vocabulary if v and len(v) >= 4}
    by = {}
    for v in known:
        by.setdefault(v[0], []).append(v)
    out = {}
    for q in {a.lower() for a in asked if a}:
        if len(q) < 4 or q in known:
            continue
        ranked = []
        for v in by.get(q[0], []):
            if abs(len(q) - len(v)) <= 2:
                r = difflib.SequenceMatcher(None, q, v).ratio()
                if r >= (min_ratio if max(len(q), len(v)) >= 7 else max(min_ratio, 0.86)):
                    ranked.append((-r, v))
        ranked.sort()
        if ranked and (-ranked[0][0] >= 0.94 or -ranked[0][0] - (-ranked[1][0] if len(ranked) > 1 else 0) >= margin):
            out[q] = (ranked[0][1], -ranked[0][0])
    return out


@pytest.mark.parametrize("min_ratio, margin", [(0.88, 0.08), (0.82, 0.06)])
def test_corrections_are_those_of_all_pairs(spark, min_ratio, margin):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.choice([3, 4, 5, 7, 9, 12, 18, 30, 45]))) for _ in range(1500)] + ["Straße", "naïve", None]
    asked = [None, "abc", "abcd", "STRASSE", "naive"]
    for w in words[:700]:
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ce"])
            w = w or ["a"]
        asked.append("".join(w))
    df = lambda rows: spark.createDataFrame([(r, 1) for r in rows], "term string, other int")
    got = {r["term"]: (r["corrected"], r["ratio"]) for r in typos.corrections(df(words), df(asked), min_ratio, margin).collect()}
    assert got == brute_corrections(words, asked, min_ratio, margin) and len(got) > 50
    assert typos.corrections(df([]), df(asked)).count() == 0 and typos.corrections(df(words), df([])).count() == 0


def test_expansion_over_the_documents(spark, sf):
    from tessera.functions.text import terms
    from tessera.plans.search_queries import typed_terms

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).distinct().collect()
    asked = [(r["query_id"], r["term"]) for r in typed_terms(spark, sf).collect()]
    found = brute_corrections([r["t"] for r in docs], [t for _, t in asked], 0.88, 0.08)
    want = {(q, t, False) for q, t in asked} | {(q, found[t.lower()][0], True) for q, t in asked if t.lower() in found and (q, found[t.lower()][0]) not in set(asked)}
    assert {tuple(r) for r in QUERIES["r0_expanded_terms"](spark, sf).collect()} == want and any(a for *_, a in want)


def walk(edges, seeds, hops, max_items, least):
    """One query's closure, step by step: path -> (distance, reason, source, confidence)."""
    from tessera.operators.graph import CLOSURE, DECAY

    seen, level, out = set(seeds), set(seeds), {}
    for hop in range(1, hops + 1):
        met = [(-CLOSURE.get(k, 0.6) * DECAY ** (hop - 1), d, s, k) for s, d, k in edges if s in level and d not in seen]
        level = set()
        for c, d, s, k in sorted(m for m in met if -m[0] >= least):
            if d not in seen and len(out) < max_items:
                seen.add(d)
                out[d] = (hop, k, s, -c)
                if k != "semantic-ref":
                    level.add(d)
    return out


def test_graph_credit_is_that_of_each_query(spark, sf):
    from tessera.operators.graph import CLOSURE
    from tessera.plans.search_queries import ranked_parts

    ranked, edges = ranked_parts(spark, sf)
    edges = sorted(tuple(r) for r in edges.select("src", "dst", "kind").collect())
    by = {}
    for r in ranked.collect():
        by.setdefault(r["query_id"], []).append(r)
    want, semantic = {}, {}
    for q, rows in by.items():
        pool = sorted((r for r in rows if r["relevant"]), key=lambda r: (not r["priority"], r["rank"], r["path"]))
        own = walk(edges, [r["path"] for r in pool[:8]], 2, 20, 0.5)
        names = {r["path"] for r in pool}
        for s, d, k in edges:
            if k == "semantic-ref" and s in names and d not in names and d not in own:
                own[d] = (1, k, s, CLOSURE[k])
        seeds = [r["path"] for r in sorted((r for r in rows if r["path"] % 2 == 0), key=lambda r: r["rank"])][:12]
        near = {d: (-c, s, k) for d, (_, k, s, c) in walk(edges, seeds, 1, 24, 0.8).items()}
        for s, d, k in edges:
            if k == "semantic-ref" and s in seeds and d not in seeds:
                near[d] = min(near.get(d, (0, s, k)), (-CLOSURE[k], s, k))
        for r in rows:
            p = r["path"]
            want[q, p] = (round(2.5 * own[p][3], 6), f"{own[p][1]}:{own[p][2]}@{own[p][0]}") if p in own else (0.0, None)
            semantic[q, p] = (round(min(10.0, -2.5 * near[p][0]), 6), f"{near[p][2]}:{near[p][1]}") if p in near else (0.0, None)
    for name, expected in (("r8_graph_credit", want), ("r13_semantic_credit", semantic)):
        got = {(r["query_id"], r["path"]): (r["graph"], r["reason"]) for r in QUERIES[name](spark, sf).collect()}
        assert got == expected and any(g for g, _ in expected.values()), name
