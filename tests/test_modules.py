"""References of modules and typed edges, on planted sources and against a plain loop."""

from pathlib import PurePosixPath

from pyspark.sql import functions as F

from tessera.operators.modules import KINDS, module_refs, typed_edges

SOURCE = """
import { run, type Shape as Form, unused, stop as halt } from './engine'
import main from "../lib/main"
import * as util from './util'
const { read: load, write } = require('fs')
export { one, two as deux } from './numbers'
export * from './all'
export type { T } from './types'
import $, { q } from './dollar'
run(1); halt ( 2 ); const f: Form = main
util.size(f); util.names.map(x); util.flag; load(write)
const a = foo.main; $.ready()
"""


def test_planted_references(spark):
    df = spark.createDataFrame([("app/x.ts", SOURCE), ("b.ts", ""), ("c.ts", None)], "src string, text string")
    got = {(r["module"], r["symbol"], r["local"], r["kind"]) for r in module_refs(df).collect()}
    call, ref, again = "semantic-call", "semantic-ref", "reexport"
    assert got == {
        ("./engine", "run", "run", call), ("./engine", "stop", "halt", call), ("./engine", "Shape", "Form", ref), ("../lib/main", "default", "main", ref),
        ("./util", "size", "util.size", call), ("./util", "names", "util.names", call), ("./util", "flag", "util.flag", ref),
        ("fs", "read", "load", call), ("fs", "write", "write", ref), ("./numbers", "one", "one", again), ("./numbers", "two", "deux", again),
        ("./all", "*", "*", again), ("./types", "T", "T", again),
    }


FILES = [
    ("src/a.ts", ["Alpha", "go"], ["b.run", "missing"], ["./b", "pkg.c"]), ("src/b.ts", ["run"], ["go", "Alpha.make"], []), ("src/c.ts", [], ["RUN"], ["./a", "./a/"]),
    ("lib/b.ts", ["make"], [], []), ("lib/index.ts", [], ["make"], ["."]), ("none", [], [], []),
]
REFS = [
    ("src/a.ts", "./c", "x", "x", "reexport"), ("src/a.ts", "./c", "y", "y", "semantic-ref"), ("src/a.ts", "./b", "run", "run", "semantic-ref"), ("src/a.ts", "./b", "z", "z", "semantic-call"),
    ("src/c.ts", "../lib", "make", "make", "semantic-ref"), ("src/c.ts", "./gone", "make", "make", "semantic-call"), ("src/b.ts", "./b", "run", "run", "semantic-call"),
]


def brute():
    name = lambda v: PurePosixPath(v).name.lower()
    keys = {p: {k for v in imp for k in (name(v), name(v).split(".")[-1]) if k} for p, _, _, imp in FILES}
    calls = {p: {c.split(".")[-1].lower() for c in cs} for p, _, cs, _ in FILES}
    defs = {p: {s.lower() for s in ss} for p, ss, _, _ in FILES}
    out = {}
    for a in keys:
        for b in keys:
            if a == b:
                continue
            stem = lambda p: PurePosixPath(p).stem.lower()
            held = {"imported-by": stem(a) in keys[b], "imports": stem(b) in keys[a], "calls-symbol": bool(defs[a] & calls[b]), "calls": bool(calls[a] & defs[b])}
            kinds = [k for k in KINDS if held.get(k)]
            if kinds:
                out[a, b] = kinds[0]
    return out | {("src/a.ts", "src/c.ts"): "reexport", ("src/a.ts", "src/b.ts"): "semantic-call", ("src/c.ts", "lib/index.ts"): "semantic-ref"}


def test_edges_as_a_loop_gives(spark):
    files = spark.createDataFrame(FILES, "path string, symbols array<string>, calls array<string>, imports array<string>")
    refs = spark.createDataFrame(REFS, "src string, module string, symbol string, local string, kind string")
    got = typed_edges(files, refs)
    assert {(r["src"], r["dst"]): r["kind"] for r in got.collect()} == brute()
    assert typed_edges(files.limit(0), refs.limit(0)).collect() == []
    assert typed_edges(files.withColumn("a", F.lit(1)).withColumn("key", F.lit(2)), refs).count() == got.count()
