"""Spelling variants against a brute force over the deletion neighbourhood."""

import collections
import random
import re
import zlib

import pytest

from tessera.llm import common, op13_variants
from tessera.llm.queries import QUERIES


def corpus_words(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute(count):
    near = {w: set() for w in count}
    alike = collections.defaultdict(set)
    for w in count:
        for i in range(len(w)):
            alike[w[:i], w[i + 1 :]].add(w)
            if (d := w[:i] + w[i + 1 :]) in count:
                near[w].add(d)
                near[d].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in count:
        top = min(near[w], key=lambda x: (-count[x], x), default=None)
        if top is not None and count[top] >= 2 * count[w]:
            form[w] = top
    out = set()
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, count[w], len(near[w]), count.get(form.get(w))))
    return out


def rows_of(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def test_query_is_the_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_variants"](spark, sf))
    want = brute(corpus_words(rows))
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in want)


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_every_bucket_size_finds_the_same(spark, bucket):
    rng = random.Random(bucket)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(600)} | {"a" * 40, "a" * 41, "a" * 20 + "b" + "a" * 20}
    count = {w: rng.choice([3, 5, 7, 20, 90]) for w in words}
    with common.scratch(spark):
        got = rows_of(op13_variants.variants(spark.createDataFrame(list(count.items()), "word string, n long"), bucket))
        assert len(got) == len(words) and set(got) == brute(count)


def test_edge_cases(spark):
    text = "Bonjour bonjour bonjour bonjou bonjou bonjou Bonj×ur ×÷×÷× ×÷×÷× ×÷×÷× abcd abcd abcd"
    rows = [(1, None, "x"), (2, "", "x"), (3, text, "x"), (3, text, "x"), (None, text, "x"), (4, "long" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    with common.scratch(spark):
        assert set(rows_of(op13_variants.variants(op13_variants.variant_words(docs)))) == brute(corpus_words([r[:2] for r in rows]))
        assert op13_variants.variants(op13_variants.variant_words(docs.where("false"))).count() == 0
