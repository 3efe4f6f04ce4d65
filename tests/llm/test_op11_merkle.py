"""The Merkle manifest against trees built in one piece."""

import collections
import random
import zlib

import pytest

from tessera.llm import common, op11_merkle
from tessera.llm.op11_merkle import H

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        a = i // 8 * 8
        yield i % 8, level[a:i] + level[i + 1 : a + 8]
        i //= 8


def brute(rows):
    """The contract's rows for (doc_id, text, lang, source, n_chars)."""

    def leaf(r, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[b"" if r[2] is None else b"1" + r[2].encode()].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups)
    trees = {g: levels([x[2] for x in groups[g].sort() or groups[g]]) for g in names}
    over = levels([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (*_, own, r) in enumerate(groups[g]):
            proof = [*path(trees[g], i), *path(over, j)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            shown = leaf(r, None if r[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])) if hit else own
            end = op11_merkle.fold(shown, proof)
            out.append((r[0], own, trees[g][-1][0], over[-1][0], H(*("".join(o) for _, o in proof)), end, end == over[-1][0]))
    return collections.Counter(out)


def found(df):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def split(spark):
    """No small partitions joined: every range partition is a segment of its own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, part string"


@pytest.mark.parametrize("sizes", [[1], [8], [9], [700, 1, 64, 65, 3], [1] * 75])
def test_trees(spark, split, sizes):
    rng = random.Random(len(sizes))
    names = [None, "zz", "é", "en", "", *[f"l{i}" for i in range(100)]]
    rows = [(10_000 * k + i, rng.choice(["Some Text", "lower", "", None]), names[k], rng.choice([None, "s"]), rng.choice([None, 4]), "x", "y") for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    with common.scratch(spark):
        assert found(op11_merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute([r[:5] for r in rows])


def test_a_stack_of_segments_holds_all_nodes():
    """Cut a tree at any places: node records and peaks of the pieces, merged, are the tree's nodes."""
    rng = random.Random(1)
    for n in (1, 7, 8, 64, 100, 520, 1000):
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(6))})
        seen = {}
        for a, z in zip(cuts, cuts[1:]):
            m = op11_merkle.Mountains(n)
            for i in range(a, z):
                m.push(0, i, bytes.fromhex(H(str(i))))
            m.close()
            assert sum(p and lv < len(m.sizes) - 1 for lv, _, _, p in m.out) <= 14 * len(m.sizes)
            seen |= {(lv, i): d.hex() for lv, i, d, _ in m.out}
        for lv, nodes in enumerate(levels([H(str(i)) for i in range(n)])):
            for i, d in enumerate(nodes):
                assert seen.get((lv, i), d) == d


def test_edge_cases_and_proofs(spark, split):
    rows = [(None, None, None, None, None, "x", "y"), (None, "Null Id", "en", None, 7, "x", "y"), (2, "Same", "en", "a", 4, "x", "y"), (2, "Same", "en", "a", 4, "x", "y"), (2, "other", "en", "a", 5, "x", "y"), (3, "Long é " * 20_000, "en", "b", 140_000, "x", "y")]
    rows += [(9, "Again", "en", "a", 5, "x", "y")] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    with common.scratch(spark):
        got = op11_merkle.manifest(docs, with_proof=True)
        assert found(got) == brute([r[:5] for r in rows])
        for r in got.collect():
            if r["verified"]:
                assert op11_merkle.fold(r["leaf"], [(s["at"], s["others"]) for s in r["proof"]]) == r["root"]
                assert op11_merkle.fold(H("forged"), [(s["at"], s["others"]) for s in r["proof"]]) != r["root"]
        assert op11_merkle.manifest(docs.where("false")).count() == 0
