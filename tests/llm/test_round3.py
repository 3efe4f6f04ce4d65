"""Loose personal data judged by context, short items' error budgets, many languages."""

import random

from pyspark.sql import functions as F

from tessera.llm import op3_pii, op5_decontaminate, op9_langid


def luhn_card(rng, right):
    d = [4, *(rng.randrange(10) for _ in range(14))]
    total = sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
    last = (10 - total % 10) % 10
    return "".join(map(str, d)) + str(last if right else (last + 1 + rng.randrange(8)) % 10)


def test_trees_decide_where_rule_and_context_differ(spark):
    """Base telephones behind a colon are real and those behind a letter too long to be any; loose ones of the same format follow."""
    rng = random.Random(0)
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    texts = []
    for i in range(400):
        texts.append(f"tel:+1 {2 + i % 8}{number(2)} 555 {number(4)} home")
        texts.append(f"lot x+1 {number(3)} 555 {number(4)} {number(6)} bin")
    loose = [("tel:212-555-0187 home", "phone:4:16"), ("lot x212-555-0187 bin", "")]
    texts += [t for t, _ in loose]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r["doc_id"]]: r for r in op3_pii.find(df).select("doc_id", op3_pii.joined("all").alias("s"), F.size("base").alias("n")).collect()}
    assert {t: got[t]["s"] for t, _ in loose} == dict(loose)
    found = {c["fits"] for r in op3_pii.candidates(df.where(f"doc_id >= {len(texts) - 2}")).collect() for c in r["candidates"] if c["form"] == 1}
    assert found == {True}  # the format alone would have let both in


def test_rejected_base_forms_never_come_back(spark):
    rng = random.Random(1)
    texts = [f"card {luhn_card(rng, True)} paid" for _ in range(300)] + [f"card {luhn_card(rng, False)} paid" for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op3_pii.find(df).collect():
        assert r["all"] == r["base"] and len(r["base"]) == (r["doc_id"] < 300)


def test_budget_is_one_edit_for_twelve_characters():
    for n, edits in ((11, 0), (12, 1), (23, 1), (24, 2), (60, 5)):
        rng = random.Random(n)
        item = "".join(rng.choice("abcdefghij") for _ in range(n))
        m = op5_decontaminate.Matcher([(1, item)], 12)
        broken = list(item)
        for i in range(edits):
            broken[i * 12 + 3] = "z"
        assert [x[:2] for x in m.find("before " + "".join(broken) + " after")] == [(1, edits)]
        broken[-1] = "y"
        assert m.find("before " + "".join(broken) + " after") == []


def test_all_languages_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 40, f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(op9_langid.fit(df, F.lit(True), rows=600).langs) == 300
