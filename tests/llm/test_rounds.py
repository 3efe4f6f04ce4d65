"""Models against numeric gradients and brute force, hot groups, row identity in the pipeline, and who deletes which tables."""

import collections
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, op1_hmm, op2_near_dedup, op4_warc, op5_decontaminate, op6_fingerprint, op7_quality, op8_bpe
from tessera.llm.queries import QUERIES
from tessera.llm.shingles import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in pairs], DOCS)


def prose(seed, n=60, words=400):
    return " ".join(np.random.default_rng(seed).choice([f"w{i}" for i in range(words)], n))


def test_op1_likelihood_rises_and_segments_change_nothing():
    rng = np.random.default_rng(1)
    prior = np.full(12, 1 / 12)
    seqs = sorted((rng.choice(12, n, p=np.roll(np.arange(1, 13) / 78, n % 12)).astype(np.uint32) for n in rng.integers(1, 60, 40)), key=lambda s: -len(s))
    model, logs = op1_hmm.Hmm.fresh(prior, 3), []
    for _ in range(12):
        sums = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 12))]
        logs.append(model.expect(seqs, *sums))
        short = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 12))]
        assert np.isclose(model.expect(seqs, *short, segment=7), logs[-1], rtol=1e-5)
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(sums, short))
        assert np.isclose(logs[-1], model.forward(seqs).sum(), rtol=1e-5)
        start, move, emit = sums  # plain maximum likelihood, without smoothing
        model = op1_hmm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), np.ascontiguousarray((emit / emit.sum(1, keepdims=True)).T) + 1e-12)
    assert all(b >= a - 1e-3 * abs(a) * 1e-2 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]


def test_op1_scores_do_not_depend_on_partitions(spark):
    df = rows_of(spark, [(i, prose(i)) for i in range(80)])
    few, many = ({r["doc_id"]: r["score"] for r in op1_hmm.hmm_scores(df.repartition(n), F.lit(False), warm_share=2).collect()} for n in (1, 7))
    assert all(math.isclose(few[i], many[i], rel_tol=1e-4) for i in few)


def test_op2_hot_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op2_near_dedup, "BLOCK_ROWS", 5)
    base = prose(0, 120, 5000).split()
    rng = np.random.default_rng(4)
    texts = []
    for i in range(90):  # a chain of near copies, copies of the base, and texts that share a part with it
        w = list(base)
        for k in rng.choice(len(w), i % 7, replace=False):
            w[k] = f"x{i}"
        texts.append(" ".join(w if i % 3 else w[:60] + prose(i, 60, 5000).split()))
    texts += [" ".join(base)] * 5
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    got = op2_near_dedup.near_duplicates(rows_of(spark, enumerate(texts))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))}


def test_op2_ids_that_are_null_or_repeated(spark):
    a, b = prose(1), prose(2)
    got = op2_near_dedup.near_duplicates(rows_of(spark, [(1, a), (4, a + " more"), (4, b), (None, b + " more"), (None, prose(3)), (None, prose(3))])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("1", "1", True), ("4", "1", False), ("4", "4", True), ("None", "4", False), ("None", "None", True), ("None", "None", True)]


def test_pipeline_tells_rows_apart(spark, sf):
    a, b, c = prose(1), prose(2), prose(3)
    copies = rows_of(spark, [(1, a), (4, a + " more"), (4, b), (None, b + " more"), (None, c), (None, c), (9, ""), (9, ""), (5, c + " more")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_duplicates(spark, copies, sf).collect())
    assert got == sorted([("1", a), ("4", b), ("9", ""), ("5", c + " more")])
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first()["text"]
    leaks = rows_of(spark, [(None, item), (None, "clean"), (7, item), (7, "clean"), (8, "clean"), (9, None)])
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, leaks, sf).collect()]
    assert got == [(None, "clean"), (7, "clean"), (8, "clean"), (9, None)]


def test_scratch_deletes_its_own_tables_only(spark, sf):
    found = QUERIES["op1_hmm"](spark, sf)
    outer = common.materialise(spark.range(3).toDF("x"), "outer")
    with common.scratch(spark):
        inner = common.materialise(spark.range(3).toDF("x"), "inner")
        result = common.materialise(inner, "result", result=True)
    assert outer.count() == 3 and result.count() == 3 and found.count() == 200
    assert not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))


def edits(pattern, text):
    row = np.zeros(len(text) + 1, int)
    own = np.array([ord(c) for c in text])
    at = np.arange(len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (own != ord(p)))
        row = np.minimum.accumulate(np.append(i, new) - at) + at
    return int(row.min())


def test_op5_all_pairs_of_documents_and_items(spark, sf):
    docs = {r["doc_id"]: op5_decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").collect()}
    items = {r["item_id"]: op5_decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op5_decontaminate"](spark, sf).collect()}
    for i in sorted(items)[:8]:
        x = items[i]
        budget = len(x) // 12 if len(x) >= 24 else 0
        for d, t in docs.items():
            n = edits(x, t) if budget else int(f" {x} " not in f" {t} ")
            assert got.get((d, i)) == (n if n <= budget else None), (d, i)


def test_op4_repeated_least_id_long_payloads_and_further_columns(spark):
    long = "x" * 3_000_000
    rows = [(1, "u", "same"), (1, "v", "same"), (2, "u", "same"), (5, "u", long), (6, "u", long + "y"), (7, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("sha", "payload", "first_id", "n", "archive")])
    with common.scratch(spark):
        folder = op4_warc.new_path(spark, "archives")
        got = op4_warc.read_archives(op4_warc.write_archives(df, folder), folder).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (5, 3_000_000, "response", None), (6, 3_000_001, "response", None), (7, 3_000_000, "revisit", 5)
    ]


def test_op4_packed_members_are_refused():
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"hello" * 100)
    blob = buffer.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        op4_warc.members(lambda at, n: blob[at : at + n], len(blob))


def test_op6_short_texts_estimate_without_bias(spark):
    rng = np.random.default_rng(2)
    pairs, truth = [], []
    for i in range(300):  # sets of about ten shingles, where most bins are empty
        w = [f"a{i}_{k}" for k in range(14)]
        v = list(w)
        v[int(rng.integers(0, 14))] = "other"
        pairs.append((" ".join(w), " ".join(v)))
        a, b = map(shingle_set, pairs[-1])
        truth.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(op6_fingerprint.likeness(op6_fingerprint.fingerprint(F.col("a")), op6_fingerprint.fingerprint(F.col("b")))).collect()]
    assert abs(np.mean(np.array(got) - truth)) < 0.03


def test_op6_ranges_follow_the_order_of_ids(spark):
    texts = {i * 7 % 1009: f"text number {i} of many" for i in range(1009)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in op6_fingerprint.with_next(df).select("doc_id", "next_text").collect()}
    order = sorted(texts)
    assert got == {a: texts[b] for a, b in zip(order, order[1:] + order[:1])}


def test_op7_terms_are_the_gradient_and_the_hessian():
    rng = np.random.default_rng(0)
    x, theta = rng.normal(size=(50, 4)), rng.normal(size=4)
    loss, grad, hess = op7_quality.unlabelled_terms(theta, x)
    for i in range(4):
        e = np.eye(4)[i] * 1e-5
        up, down = (op7_quality.unlabelled_terms(theta + s * e, x) for s in (1, -1))
        assert np.isclose((up[0] - down[0]) / 2e-5, grad[i], rtol=1e-5, atol=1e-6) and np.allclose((up[1] - down[1]) / 2e-5, hess[i], rtol=1e-4, atol=1e-4)


def test_op7_newton_ends_at_the_minimum_of_the_risk():
    rng = np.random.default_rng(1)
    pos, unl = np.c_[rng.normal(1, 1, (200, 2)), np.ones(200)], np.c_[np.r_[rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (700, 2))], np.ones(1000)]
    risk = lambda th: -0.3 * (pos @ th).mean() + np.logaddexp(0, unl @ th).mean() + 5e-4 * th @ th
    theta = np.zeros(3)
    for _ in range(15):
        theta = theta + op7_quality.newton_step(theta, op7_quality.unlabelled_terms(theta, unl), 1000, pos, 0.3, 1e-3)
    assert all(risk(theta) <= risk(theta + d) + 1e-9 for d in 0.01 * rng.normal(size=(50, 3)))


@pytest.mark.parametrize("prior", [0.1, 0.3, 0.6, 0.9])
def test_op7_prior_of_mixtures(prior):
    rng = np.random.default_rng(int(prior * 10))
    z = np.where(rng.random(20_000) < prior, rng.normal(2.5, 1, 20_000), rng.normal(-2.5, 1, 20_000))
    held = np.sort(rng.normal(2.5, 1, 1500))
    above = op7_quality._above(z, held)
    assert abs(op7_quality.class_prior(held[::-1], above[:-1], above[-1]) - prior) < 0.07


def test_op8_digests_of_the_query(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op8_bpe.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op8_bpe"](spark, sf).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_pipeline_over_the_whole_table(spark, sf):
    """Stage by stage against plain versions: what is kept, and what the last stage returns."""
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and set(out) <= set(texts)
    letters = {i for i, t in texts.items() if any(map(str.isalpha, t))}
    sets = {i: shingle_set(texts[i]) for i in letters}
    items = [op5_decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    twins = collections.defaultdict(list)
    for i in sorted(letters):
        twins[sets[i].tobytes()].append(i)
    assert not {i for own in twins.values() for i in own[1:]} & set(out)
    assert not [i for i in out if any(x and f" {x} " in f" {op5_decontaminate.normalise(texts[i])} " for x in items)]
