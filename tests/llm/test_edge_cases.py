"""Nulls, empty and long texts, repeated rows, empty tables and further columns, for every operator and stage."""

import pytest

import corpus_pipeline
from tessera.llm import op1_hmm, op2_near_dedup, op3_pii, op4_warc, op5_decontaminate, op6_fingerprint, op7_quality, op8_bpe, op9_langid, op10_license
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: doc_id, text, lang, source, n_chars, and columns whose names operators use inside
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", None, "a", 6), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13),
    (None, "null id with some more words here", "en", "a", 33), (7, LONG, "de", "a", len(LONG)), (8, LONG + " end", "de", "a", len(LONG) + 4), (9, "write to me@example.com now please", "en", "a", 34), (10, "12345 !!", None, "b", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "ids", "key", "class", "uid", "n", "label", "part", "head", "candidates", "component_id", "fingerprint", "decoded", "lang_pred")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_op1(docs, none):
    got = op1_hmm.hmm_scores(docs, F.lit(False), warm_passes=1, passes=1).collect()
    assert len(got) == len(ROWS) and all(r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert op1_hmm.hmm_scores(none, F.lit(False)).count() == 0
    held = op1_hmm.hmm_scores(docs, F.lit(True)).collect()
    assert len(held) == len(ROWS) and {r["train_tokens"] for r in held} == {0} and {r["n_known"] for r in held} == {0}


def test_op2(docs, none):
    got = {(r["doc_id"], r["n_shingles"]): r for r in op2_near_dedup.near_duplicates(docs).collect()}
    for i in (1, 2, 3):
        assert (got[i, 0]["component_id"], got[i, 0]["kept"]) == (i, True)
    assert got[4, 1]["component_id"] == 4 and got[7, 977]["component_id"] == 7
    assert [r["component_id"] for (i, _), r in got.items() if i == 8] == [7]
    assert [(r["component_id"], r["kept"]) for (i, _), r in got.items() if i is None] == [(None, True)]
    assert op2_near_dedup.near_duplicates(none).count() == 0


def test_op3(docs, none):
    got = op3_pii.find(docs)
    assert ids(got) == ALL
    assert [len(r["base"]) for r in got.where("doc_id = 9").collect()] == [1]
    assert op3_pii.find(none).count() == 0


def test_op4(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, sha string, first_id long")
    folder = op4_warc.new_path(spark, "archives")
    assert op4_warc.read_archives(op4_warc.write_archives(empty, folder), folder).count() == 0


def test_op5(spark, docs, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (None, LONG[:400])], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in op5_decontaminate.contaminated(docs, bench).collect())
    assert got == [("4", "3", 0), ("4", "3", 0), ("7", "None", 0), ("8", "None", 0)]
    assert op5_decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert op5_decontaminate.contaminated(none, bench).count() == 0
    assert len(op5_decontaminate.contaminated(docs, bench, block_chars=300).collect()) == 4


def test_op6(docs, none):
    assert ids(op6_fingerprint.with_next(docs)) == ALL
    assert op6_fingerprint.with_next(none).count() == 0


def test_op7(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 1), (4, 0), (7, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    model = op7_quality.fit(docs.select("doc_id", "text"), labels, F.lit(True))
    got = op7_quality.score(docs.select("doc_id", "text", "score"), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert op7_quality.fit(none.select("doc_id", "text"), labels.where("false"), F.lit(True)) is None
    assert {r["score"] for r in op7_quality.score(docs.select("doc_id", "text"), None).collect()} == {0.5}


def test_op8(docs, none):
    path = op8_bpe.tokenizer_path()
    got = op8_bpe.decode(op8_bpe.encode(docs, path), path)
    assert ids(got) == ALL and all(r["decoded"] == (r["text"] or "") for r in got.collect())
    assert op8_bpe.decode(op8_bpe.encode(none, path), path).count() == 0


def test_op9(docs, none):
    net = op9_langid.fit(docs, F.lit(True))
    got = op9_langid.predict(docs, net).collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 10)} == {"und"}
    assert op9_langid.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in op9_langid.predict(docs, None).collect()} == {"und"}
    assert op9_langid.predict(none, net).count() == 0


def test_op10(spark, none):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (1, "Released under the MIT license"), (None, "Licensed under CC BY 4.0."), (2, None), (3, ""), (4, "released")]
    got = sorted((str(r["doc_id"]), r["license"], r["n_units"], r["dice"]) for r in op10_license.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "MIT short", 2, 1.0), ("None", "CC-BY-4.0 short", 1, 1.0)]
    assert op10_license.licences(none).count() == 0


def test_stages(spark, sf, docs, none, tmp_path):
    current, empty = docs, none
    want = [[4, 4, 7, 8, 9, None], [4, 7, 9, None], [4, 7, 9, None], [4, 7, 9, None], [4, 7, 9, None]]
    for i, ((name, stage), kept) in enumerate(zip(corpus_pipeline.STAGES, want)):
        for kind, frame in (("full", current), ("none", empty)):
            out = stage(spark, frame, sf)
            if i < 4:
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
            out.write.parquet(str(tmp_path / f"{kind}{i}"))
        current, empty = (spark.read.parquet(str(tmp_path / f"{kind}{i}")) for kind in ("full", "none"))
        assert ids(current) == kept and empty.count() == 0, name
        if i == 3:
            assert current.where("doc_id = 9").first()["text"] == "write to [EMAIL] now please"


def test_pipeline(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 100 and got.select("doc_id").distinct().count() == got.count()
