"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, op3_pii, op4_warc, op5_decontaminate, op6_fingerprint, op8_bpe
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.shingles import set_digest, shingle_set
from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return (text or "").encode().lower().split() if (text or "").isascii() else (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


def jaccard(a, b):
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_op1_base_and_better_than_base(spark, sf, docs):
    got = QUERIES["op1_hmm"](spark, sf).collect()
    tokens = {i: [*words(t), b"\n"] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(counts[w] > 0 for w in t), n)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op1_forward_recursion_is_exact():
    from tessera.llm.op1_hmm import Hmm

    rng = np.random.default_rng(0)
    m = Hmm.fresh(np.full(5, 0.2), 3)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (4, 3, 1)]
    log, want = m.forward(seqs), []
    for s in seqs:  # sum over all paths
        total = 0.0
        for path in np.ndindex(*([3] * len(s))):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        want.append(math.log(total))
    assert np.allclose(log, want)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    m.expect(seqs, start, move, emit)
    assert np.isclose(start.sum(), 3) and np.isclose(move.sum(), 5) and np.isclose(emit.sum(), 8)


def test_op2_components_are_those_of_all_pairs(spark, sf, docs):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a) and len(b) and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    label[max(x, y)] = min(x, y)
    for r in QUERIES["op2_near_dedup"](spark, sf).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)


def test_components(spark):
    rng = np.random.default_rng(3)
    path = rng.permutation(3000).tolist()
    for edges in ([(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)], list(zip(path, path[1:])), [(i, 7) for i in range(3000)]):
        df = spark.createDataFrame(edges, "u long, v long").repartition(17)
        nodes, comp = graph.labels_of(*np.array([e for e in edges if e[0] != e[1]]).T)
        got = graph.components(df).collect()
        assert len(got) == len(nodes) and {r["node"]: r["comp"] for r in got} == dict(zip(nodes.tolist(), comp.tolist()))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [s for *_, s in sorted(found)]


def test_op3_base_spans(spark, sf, docs):
    for r in QUERIES["op3_pii"](spark, sf).collect():
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        for k in PATTERNS:
            assert r[f"n_{k}"] == sum(s.startswith(k + ":") for s in want)


def test_op3_hard_texts(spark):
    texts = ["a@b.co_x@c.de 1.2.3.4.5.6.7.8 +1 2 3 4 5 6 7 8 9 0 é 4111 1111 1111 1111", "😀 x.y@é.z a@b@c.de.f.. @a.b +++1234567890123 256.1.1.1 1.1.1.0255 a@b.c-@d.e", "9" * 30000, "1 " * 20000, "+" * 1000 + "1" * 20000, "a" * 50000 + "@", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op3_pii.candidates(df)
    got = {r["doc_id"]: r["b"] for r in op3_pii.spans(found, None, {}).select("doc_id", op3_pii.joined("base").alias("b")).collect()}
    assert all(got[i] == ",".join(base_spans(t)) for i, t in enumerate(texts) if i != 5)
    both = df.join(op3_pii.spans(found, None, {}), "doc_id").where("doc_id = 0").select(op3_pii.redact(F.col("text"), F.col("all"))).first()[0]
    assert both == "[EMAIL][EMAIL] [IP].[IP] [PHONE] é [CARD]"


def test_op4_records(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(10_000, None, None), (10_001, "http://a/\r\nb", ""), (10_002, "u", "same"), (10_003, "u", "same"), (None, "u", "same")], "page_id long, url string, html string")
    all_pages = pages.union(more)
    folder = op4_warc.new_path(spark, "archives")
    got = op4_warc.read_archives(op4_warc.write_archives(all_pages, folder), folder, payloads=True).collect()
    rows = all_pages.collect()
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[r["html"] or ""] = min(r["page_id"], first.get(r["html"] or "", r["page_id"]))
    assert len(got) == len(rows)
    want = sorted(repr((r["page_id"], len((r["html"] or "").encode()), op4_warc.digest32((r["html"] or "").encode()), "response" if first[r["html"] or ""] == r["page_id"] else "revisit", None if first[r["html"] or ""] == r["page_id"] else first[r["html"] or ""])) for r in rows)
    assert want == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    html = {r["page_id"]: r["html"] or "" for r in rows}
    assert all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in got if r["record_type"] == "response")


def test_op4_zip64(tmp_path):
    import io
    import struct
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"hello")
        z.writestr("b", b"x" * 1000)
    raw = bytearray(buffer.getvalue())
    end = raw.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", raw, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    struct.pack_into("<HHII", raw, end + 8, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
    data = bytes(raw[:end]) + wide + locator + bytes(raw[end:])
    for blob in (buffer.getvalue(), data):
        found = op4_warc.members(lambda at, n: blob[at : at + n], len(blob))
        assert {k: blob[a : a + n] for k, (a, n) in found.items()} == {"a": b"hello", "b": b"x" * 1000}


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_op5_myers_and_planted_errors(spark, sf, docs):
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 90), rng.integers(0, 120)))
        assert op5_decontaminate.myers(a, b)[0] == edits(a, b)
    item = "the quick brown fox jumps over the lazy dog and then runs away from the farm at night"
    matcher = op5_decontaminate.Matcher([(1, item), (2, "short one"), (3, None), (4, "")], 12)
    budget = len(item) // 12
    for k in range(budget + 3):
        at = rng.choice(len(item), k, replace=False) if k else []
        text = "some words before " + "".join("q" if i in at and c != "q" else c for i, c in enumerate(item)) + " and after"
        d = edits(op5_decontaminate.normalise(item), op5_decontaminate.normalise(text))
        found = [x for x in matcher.find(text) if x[0] == 1]
        assert bool(found) == (d <= budget) and (not found or found[0][1] == d)
    assert matcher.find("a short one here")[0][:2] == (2, 0) and not matcher.find("ashort one here") and not matcher.find(None)


def test_op5_exact_passages(spark, sf, docs):
    items = [(r["item_id"], op5_decontaminate.normalise(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs.items() for i, x in items if x and x in op5_decontaminate.normalise(t)}
    assert want <= {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontaminate"](spark, sf).collect()}


def test_op6_fingerprints(spark, sf, docs):
    ids = sorted(docs)
    errors = []
    for r in QUERIES["op6_fingerprint"](spark, sf).collect():
        i = r["doc_id"]
        t, after = docs[i] or "", docs[ids[(ids.index(i) + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(shingle_set(t), shingle_set(edited)), r["near_next"] - jaccard(shingle_set(t), shingle_set(after))]
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04


def test_op6_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "one two three"), (4, "one two three"), (None, "x y z a b c"), (9, long)]
    got = op6_fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert len(got) == len(rows)
    assert by[1, ""]["fingerprint"] == "" and by[4, "one two three"]["next_text"] in ("one two three", long)
    assert by[9, long]["next_text"] == "x y z a b c" and by[None, "x y z a b c"]["next_text"] == ""
    assert len(by[3, "one"]["fingerprint"]) == 256 and by[3, "one"]["fingerprint"] != by[4, "one two three"]["fingerprint"]


def test_op7_held_out_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf.replace("0.001", "0.01")).collect()}
    labels = [r for r in spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_op8_same_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op8_bpe.tokenizer_path())
    own = op8_bpe.SpeculativeBpe(op8_bpe.tokenizer_path())
    rng = np.random.default_rng(8)
    odd = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000, "\0", "éé  \n\n ", "I'll don't", "日本語 テスト 123", "".join(map(chr, rng.integers(32, 0x3000, 3000)))]
    texts = [t or "" for t in docs.values()] + odd
    flat, at = own.encode(texts)
    want = lib.encode_batch(texts, add_special_tokens=False)
    for w, a, z in zip(want, at, at[1:]):
        assert w.ids == flat[a:z].tolist()
    assert own.decode(flat, at) == [lib.decode(w.ids, skip_special_tokens=False) for w in want]
    broken = np.array([i for i in range(200, 256)])
    assert own.decode(broken, np.array([0, len(broken)]))[0] == lib.decode(broken.tolist(), skip_special_tokens=False)


def test_op9_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op9_langid"](spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), connection(sf), ORACLE_SQL[name])


def test_digest_of_the_empty_set():
    assert set_digest(shingle_set("  ")) is None
