"""Prefix dynamic programming against the public library and against merging by definition."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tessera.llm import op12_prefix_bpe
from tessera.llm.queries import QUERIES


@pytest.fixture(scope="module")
def bpe():
    return op12_prefix_bpe.PrefixBpe(*op12_prefix_bpe.vocabulary())


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=bpe.pattern_text, mergeable_ranks=bpe.id_of, special_tokens={})


def encoded(bpe, texts):
    flat, at = bpe.encode(texts)
    return [flat[a:z].tolist() for a, z in zip(at, at[1:])]


def test_query_is_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_prefix_bpe"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_every_character(bpe, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 997])) for i in range(0, len(points), 997)] + ["a" * 5000, "=" * 3000, " " * 4000 + "x", "'s 'RE ''ll"]
    assert encoded(bpe, texts) == [library.encode_ordinary(t) for t in texts]


def test_fits_is_merging(bpe):
    rng = random.Random(0)
    own = [t for t in rng.sample(range(bpe.size), 3000) if bpe.spine(t)]
    common = [t for t in own if len(bpe.bytes_of[t]) < 4]
    for _ in range(20_000):
        a, b = rng.choice(common), rng.choice(own)
        assert bpe.fits(a, b) == (bpe.merge_steps(bpe.bytes_of[a] + bpe.bytes_of[b])[0] == [a, b])


def test_small_vocabularies_with_merges_out_of_order(tmp_path):
    """Random ranks over two letters: parts may rank after what they merge to, and tokens may not encode to themselves."""
    import base64

    for seed in range(60):
        rng = random.Random(seed)
        tokens = [bytes([b]) for b in range(256)] + rng.sample(sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(40)}), 12)
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
        own = op12_prefix_bpe.PrefixBpe(str(path), op12_prefix_bpe.vocabulary()[1])
        library = tiktoken.Encoding("own", pat_str=own.pattern_text, mergeable_ranks=own.id_of, special_tokens={})
        try:
            texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
            got = encoded(own, texts)
        except ValueError:
            continue
        assert got == [library.encode_ordinary(t) for t in texts], seed


def test_prefix_table(bpe):
    rng = random.Random(2)
    word = "".join(rng.choice(["tion", "eau", "x", "é", "ing", "12"]) for _ in range(2000)).encode()
    table = op12_prefix_bpe.PrefixTable(bpe, word[:3000])
    table.append(word[3000:])
    for end in (0, 1, 17, 2999, len(word)):
        assert table.tokens(end) == bpe.merge_steps(word[:end])[0]
    table.computed = 0
    for start, end, new in ((4000, 4003, b"eau"), (10, 10, b"z"), (2000, 2600, b""), (0, 1, b""), (len(table.word) - 1700, len(table.word) - 1699, b"qqqq")):
        table.replace(start, end, new)
        assert table.tokens() == bpe.merge_steps(table.word)[0]
    assert table.computed < 1000


def test_edits(bpe, library):
    rng = random.Random(3)
    pieces = ["the ", "eau ", "  ", "\n", "'s", "'", "r", "e", " 12", "é", "x y", "."]
    for k in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 3, 30, 3000 if k % 50 == 0 else 10])))
        start = rng.randint(0, len(text) + 2)
        end = start + rng.choice([0, 1, 5])
        new = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 3)))
        changed, ids = bpe.edit(text, np.array(library.encode_ordinary(text), "<u4"), start, end, new)
        assert changed == text[:start] + new + text[max(end, start) :] and ids.tolist() == library.encode_ordinary(changed)


def test_edge_cases(spark, library):
    rows = [(1, None, 0, 0, "new"), (2, "", 5, 9, "more words"), (3, "one two three", 4, 7, "2"), (3, "one two three", 4, 7, "2"), (None, "null id", None, 1, "x"), (4, "word " * 20_000, 50_000, 50_001, "WORD")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, end int, new string").selectExpr("*", "'x' as decoded", "'y' as ids_sha256")
    args = op12_prefix_bpe.vocabulary()
    own = op12_prefix_bpe.encode(docs, *args)
    back = op12_prefix_bpe.decode(own, *args).collect()
    assert sorted(map(str, (r["doc_id"] for r in back))) == sorted(str(r[0]) for r in rows)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    for r in op12_prefix_bpe.edit(own, *args).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
    assert [r["text"] for r in op12_prefix_bpe.edit(own, *args).where("doc_id = 3").collect()] == ["one 2 three"] * 2
    assert op12_prefix_bpe.digests(op12_prefix_bpe.decode(op12_prefix_bpe.encode(docs.where("false"), *args), *args)).count() == 0
