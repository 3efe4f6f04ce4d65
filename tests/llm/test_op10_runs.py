"""Planted licence notices: wrapped, within paragraphs, in blank-line layouts, and look-alikes."""

import pytest

from tessera.llm.op10_license import NOTICES, notices

MORE = "A parser for logs, written in spring. It reads lines and counts them."


def wrapped(text, n=7, prefix="# "):
    w = text.split()
    return "\n".join(prefix + " ".join(w[i : i + n]) for i in range(0, len(w), n))


BSD = NOTICES["BSD-3-Clause"]
LAID_OUT = f"Copyright 2020 Someone\n\n{BSD.replace(' 1. ', chr(10) * 2 + '1. ').replace(' 2. ', chr(10) * 2 + '2. ').replace(' 3. ', chr(10) * 2 + '3. ')}\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
CASES = [
    ("Licensed under the MIT License.", {"MIT short licensed"}), ("This project is released under the MIT License.", {"MIT short released"}), (f"{MORE} Released under the MIT License. {MORE}", {"MIT short"}),
    (BSD, {"BSD-3-Clause"}), (LAID_OUT, {"BSD-3-Clause"}), (f"{MORE}\n{wrapped(NOTICES['MIT'])}\n{MORE}", {"MIT"}), (f"{MORE}\n{wrapped(NOTICES['Apache-2.0 header'])}\n{MORE}", {"Apache-2.0 header"}),
    *[(f"{MORE}\n{wrapped(NOTICES[n], 11)}\n\n{MORE}", {n}) for n in NOTICES if n.endswith("or-later header")],
    (NOTICES["LGPL-3.0"], {"LGPL-3.0"}), (f"{NOTICES['GPL-2.0']}\n{MORE}\n{NOTICES['CC-BY-4.0']}", {"GPL-2.0", "CC-BY-4.0"}), (MORE, set()), ("The MIT licence office is under the stairs.", set()), ("", set()), (None, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(len(CASES), CASES[0][0])] * 2, "doc_id long, text string")
    return notices(df).collect()


def test_planted_notices(found):
    got = [{r["license"] for r in found if r["doc_id"] == i} for i in range(len(CASES))]
    assert got == [want for _, want in CASES]


def test_rows_of_one_id_count_together(found):
    assert [(r["license"], r["n_units"], r["dice"]) for r in found if r["doc_id"] == len(CASES)] == [("MIT short licensed", 2, 1.0)]
