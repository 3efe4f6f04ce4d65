"""Processors of command output: what each keeps, and that nothing critical is lost and nothing grows."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import CRITICAL
from tessera.operators import processors as P

FILLER = "\n".join(f"chatter number {i} that says nothing of use" for i in range(200))
STATUS = "On branch main\nYour branch is up to date with 'origin/main'.\n\nChanges to be committed:\n  (use \"git restore\")\n\tmodified:   a.py\n\tnew file:   b.py\n\nChanges not staged for commit:\n  (use \"git add\")\n\tdeleted:    c.py\n\nUntracked files:\n  (use \"git add\")\n\td.py\n\n"
LOG = "commit 0123456789abcdef (HEAD -> main, tag: v1)\nAuthor: A <a@b>\nDate:   Mon\n\n    First subject\n\n    more\n\n a.py | 3 ++-\n 2 files changed, 2 insertions(+), 1 deletion(-)\n\ncommit fedcba9876543210\nAuthor: B <b@c>\nDate:   Tue\n\n    Second\n"
DIFF = "diff --git a/x b/x\nindex 1..2 100644\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n context\n-old\n+new\n context\n"
PYTEST = f"{FILLER}\n=== FAILURES ===\n__ test_a __\nE assert 1 == 2\n=== short test summary info ===\nFAILED a.py::test_a\n=== 1 failed, 3 passed in 1s ===\n"
CASES = [
    ("git status", STATUS, False, "On branch main\nYour branch is up to date with 'origin/main'.\nS modified: a.py\nS new file: b.py\nU deleted: c.py\n? d.py\n"),
    ("git log --stat", LOG, False, "01234567 [HEAD>main,tag: v1] First subject [2f +2 -1]\nfedcba98 Second\n"),
    ("git diff", DIFF, False, "diff --git a/x b/x\n@@ -1,3 +1,3 @@\n-old\n+new\n"),
    ("go test ./...", FILLER + "\n--- FAIL: TestA (0.0s)\na_test.go:3: bad\na_test.go:3: bad\nFAIL\tpkg\t0.1s\n", True, "--- FAIL: TestA (0.0s)\na_test.go:3: bad\nFAIL\tpkg\t0.1s\n"),
    ("rg x", "a\nb\n" * 40, False, "[filtered search: 80 lines → 2 unique hits, 78 omitted]\na\nb\n"),
    ("rg -C 3 x", "a\nb\n" * 40, False, "a\nb\n" * 40),
    ("mypy src", FILLER + "\na.py:1: error: bad\nFound 1 error\n", True, "[filtered mypy: 202 lines → 2 kept, 200 omitted]\na.py:1: error: bad\nFound 1 error\n"),
    ("echo", "short\n", False, "short\n"), ("echo", None, False, None), ("echo", "", None, ""), ("", FILLER[:0], False, ""),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, command string, text string, failed boolean")
    got = {r["i"]: r["result"] for r in P.compressed(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)}


def test_pytest_keeps_failures_and_summary(spark):
    df = spark.createDataFrame([("pytest -q", PYTEST, True)], "command string, text string, failed boolean")
    r = P.compressed(df).first()
    assert r["processor"] == "pytest" and r["result"].startswith("[filtered pytest: 206 lines → failures/summary]\n=== FAILURES ===") and r["result"].rstrip().endswith("1 failed, 3 passed in 1s ===")


def test_failed_output_skips_processors_that_do_not_take_it(spark):
    df = spark.createDataFrame([("git diff", False), ("git diff", True), ("git diff", None), ("kubectl logs x", True), ("ruff check", True), ("pip install x", False)], "c string, f boolean")
    assert [r[0] for r in df.select(P.route(F.col("c"), F.col("f"))).collect()] == ["git-diff", "generic", "git-diff", "generic", "ruff", "package-install"]


@pytest.mark.parametrize("command", ["kubectl logs x", "make", "cargo test", "npm install", "git log"])
def test_critical_lines_survive_and_nothing_grows(spark, command):
    text = FILLER + "\nTraceback (most recent call last)\n" + FILLER + "\nCaused by: disk\n" + FILLER + "\n" + "x" * 400
    df = spark.createDataFrame([(command, text, False), (command, text * 3, True)], "command string, text string, failed boolean")
    for r in P.compressed(df).collect():
        assert len(r["result"].encode()) <= len(r["text"].encode()) and r["changed"]
        assert {x.strip() for x in r["text"].split("\n") if re.search(CRITICAL, x)} <= {x.strip() for x in r["result"].split("\n")}
