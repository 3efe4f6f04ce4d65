"""Loose forms of personal data among base forms and look-alikes."""

import corpus_pipeline
from tessera.llm import op3_pii

BASE = ["Ring +1 (743) 555-3824 today", "Ring +1 (212) 555-0187 or +44 20 7946 0958", "Mail me@example.com", "Host 10.1.2.3 is up", "Card 4111 1111 1111 1111 paid"]
#: text, and its span
LOOSE = [
    ("Ring (743) 555-3824 today", "phone:5:19"), ("212-555-0187 is mine", "phone:0:12"), ("See 2001:db8:0:1:85a3:8a2e:370:7334 there", "ip:4:35"),
    ("write to jane.doe [at] example.org now", "email:9:34"), ("joe(at)mail[dot]example(dot)com", "email:0:31"),
]
OTHER = ["order id 743-555-3824", "part 123-456-7890 x", "at 12:34:56:78 it began", "card 00:1b:44:11:3a:b7 of the net", "unit 00:1b:44:11:3a:b7:00:01 x"]


def docs_of(spark, loose):
    texts = BASE * 30 + [t for t, _ in LOOSE] * loose + OTHER * 3
    return texts, spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_loose_forms_are_found_rare_or_common(spark):
    for loose in (1, 40):
        texts, df = docs_of(spark, loose)
        got = {texts[r["doc_id"]]: r["s"] for r in op3_pii.find(df).select("doc_id", op3_pii.joined("all").alias("s")).collect()}
        assert {t: got[t] for t, _ in LOOSE} == dict(LOOSE)
        assert {got[t] for t in OTHER} == {""}


def test_national_part_of_a_base_span_is_no_candidate(spark):
    _, df = docs_of(spark, 0)
    found = [(c["form"], c["valid"]) for r in op3_pii.candidates(df.where(df.doc_id < len(BASE))).collect() for c in r["candidates"]]
    assert found and all(form == 0 for form, _ in found)


def test_redaction_stage_takes_loose_forms(spark, sf):
    texts, df = docs_of(spark, 3)
    clean = {texts[r["doc_id"]]: r["text"] for r in corpus_pipeline.redacted(spark, df, sf).collect()}
    assert clean["Ring (743) 555-3824 today"] == "Ring [PHONE] today" and clean["write to jane.doe [at] example.org now"] == "write to [EMAIL] now"
    assert clean["order id 743-555-3824"] == "order id 743-555-3824"
