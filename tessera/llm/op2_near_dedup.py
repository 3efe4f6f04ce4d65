"""MinHash near-duplicate detection by a multi-index Hamming join.

Texts with the same set of five-word shingles are one class (an aggregation). A class has a signature of 512 MinHash
symbols. The first 64, of 16 bits, are split into 16 chunks of 4: by pigeonhole, two signatures that differ in at most 31
of the 64 symbols have a chunk with at most one error, so each class is filed under the 64 keys that leave out one symbol
of one chunk (all allowed errors of all chunks), and every pair within that distance meets in a bucket. Distance counts
symbols, not single bits: at a similarity of 0.75 a quarter of the symbols differ, and over single bits such a radius
would put every pair of documents into some bucket. At similarity 0.75 the chance to differ in more than 31 of 64 symbols
is below 1 in 50,000. Pairs of a bucket are first held to the distance over all 512 symbols (low 4 bits; MAX_DIFFERENT is
3.7 standard deviations above the mean at 0.75, which a pair right at 0.75 misses once in 9,000 times) and to the ratio of the set sizes, then confirmed on the full sets.

No bucket ever yields all its pairs. Two star rounds, each over the buckets of four chunks, pair every member with the
pivot of its bucket, by an equi-join on the bucket's key, confirm the nearest, and form components; only then pairs across components are looked at. There a bucket is split into
blocks of about BLOCK_ROWS rows: rows of one (large) component are dealt over blocks, the other rows meet each of them, so
no task holds more than two blocks, whatever the bucket's size. Classes are numbered in the order of their least doc_id, so
the least number of a component is that of its least doc_id.

Edge cases: null, empty and blank texts have the empty set, are linked with nothing and are their own component; texts of
fewer than five words have one shingle; repeated rows share a class; rows of one id with different texts are judged one by
one; a null doc_id never names a component unless all its members are null, then component_id is null and all are kept; an
empty table gives an empty table; further columns are ignored but for those named in ``also``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import handing_back, materialise, pieces, scratch, table
from tessera.llm.graph import components
from tessera.llm.shingles import mix, set_digest, shingle_set, signatures

SYMBOLS, KEY_SYMBOLS, CHUNK = 512, 64, 4
#: Of 512 symbols with 4 bits kept: mean 120 and standard deviation 9.6 at similarity 0.75.
MAX_DIFFERENT = 156
#: Bits of the bitmap of needed documents for each of them, and its bounds (32 KB to 128 MB, broadcast).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 18, 30
#: Orders that choose pivots, and how many of the pivots near it a class is verified with in a star round.
ORDERS, NEAREST = 4, 3
#: Rows of a block of a bucket.
BLOCK_ROWS = 2000


def _digested(docs: DataFrame, also: list[str]) -> DataFrame:
    """doc_id, further columns, n_shingles, class (16 bytes, null for the empty set) and signature of each row of (text, doc_id, also)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            sigs = [signatures(s, SYMBOLS) if len(s) else None for s in sets]
            keys = [None if x is None else x[:KEY_SYMBOLS].tobytes() for x in sigs]
            low = [None if x is None else _pack(x) for x in sigs]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.binary()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=["doc_id", *also, "n_shingles", "class", "symbols", "sketch"])

    own = docs.select("text", "doc_id", *also)
    more = T.StructType(own.schema.fields[1:]).add("n_shingles", "long").add("class", "binary").add("symbols", "binary").add("sketch", "binary")
    return own.mapInArrow(handing_back(run), more)


def _pack(sig: np.ndarray) -> bytes:
    low = (sig & 15).astype(np.uint8)
    return ((low[0::2] << 4) | low[1::2]).tobytes()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, KEY_SYMBOLS)
            keys = chunk_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))], names=["key", "cid"])


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature its keys: chunk, symbol left out, and the other three symbols (48 bits)."""
    s = sig.astype(np.int64).reshape(len(sig), -1, CHUNK)
    out = np.empty((*s.shape[:2], CHUNK), np.int64)
    for w in range(CHUNK):
        a, b, c = (i for i in range(CHUNK) if i != w)
        out[:, :, w] = (np.arange(s.shape[1]) * CHUNK + w << 48) | s[:, :, a] << 32 | s[:, :, b] << 16 | s[:, :, c]
    return out.reshape(len(sig), -1)


def _grouped(names: list[str], each: Callable[[dict[str, np.ndarray]], list[tuple]], schema: pa.Schema):
    """A function over batches sorted by their first column that hands whole groups of two rows or more to ``each``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        seen: set[tuple] = set()

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = t.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(edges[1:], len(key))
            cols = {n: (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(key), -1) if pa.types.is_binary(c.type) else c.to_numpy()) for n, c in zip(names, t.columns)}
            found: list[tuple] = []
            for a, z in zip(edges.tolist(), ends.tolist()):
                if z - a > 1:
                    for x in each({n: c[a:z] for n, c in cols.items()}):
                        if x not in seen:
                            seen.add(x)
                            found.append(x)
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                    if len(seen) > 100_000:
                        seen.clear()
            if found:
                yield out(found)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            if b.column(0)[0].as_py() == b.column(0)[b.num_rows - 1].as_py() or sum(t.num_rows for t in held) < 4096:
                continue
            t = pa.concat_tables(held).combine_chunks()
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            held = [t.slice(cut)]
            if cut:
                yield from work(t.slice(0, cut))
        if held:
            yield from work(pa.concat_tables(held).combine_chunks())

    return run


def _multi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, cid) sorted by key, the rows whose key occurs more than once."""
    last = None  # the last row so far, and whether it has been passed on
    for b in batches:
        if not b.num_rows:
            continue
        key, cid = b.column(0).to_numpy(), b.column(1).to_numpy()
        if last is not None and not last[2]:
            key, cid = np.append(last[0], key), np.append(last[1], cid)
        same = np.append(key[1:] == key[:-1], False)
        same[1:] |= same[:-1].copy()
        if last is not None and last[2]:
            same[: np.searchsorted(key != last[0], True) if key[0] == last[0] else 0] = True
        last = (key[-1], cid[-1], bool(same[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(key[same]), pa.array(cid[same])], names=["key", "cid"])


def _different(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x ^ y
    return ((z & 15) != 0).sum(-1, dtype=np.int32) + ((z >> 4) != 0).sum(-1, dtype=np.int32)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with set sizes and sketches, those near enough: u, v, distance and the other columns before the sketches."""
    for b in pieces(batches, 8192):
        n, m, x, y = (b.column(i) for i in range(4))
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (x, y))
        n, m = n.to_numpy(), m.to_numpy()
        d = _different(x, y)
        ok = pa.array((d <= MAX_DIFFERENT) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * 75))
        yield pa.RecordBatch.from_arrays([*(c.filter(ok) for c in b.columns[4:]), pa.array(d.astype(np.int64)).filter(ok)], names=["u", "v", "lu", "lv", "d"])


def _cross(g: dict[str, np.ndarray]) -> list[tuple]:
    """All pairs across components, and across sides where the group has two, that pass the distance, block by block."""
    cid, lab, sk, side, key, sym = g["cid"], g["label"], g["sketch"], g["side"], g["key"], g["symbols"]
    every = np.arange(len(cid))
    found: list[tuple] = []
    for a in range(0, len(cid), 128):
        x = slice(a, a + 128)
        for b in range(a, len(cid), 512):
            y = slice(b, b + 512)
            apart = (lab[x, None] != lab[None, y]) & (every[x, None] < every[None, y]) & (key[x, None] == key[None, y])
            apart &= (side[x, None] != side[None, y]) | (side[x, None] < 0)
            n, m = g["n"][x, None], g["n"][None, y]
            apart &= np.minimum(n, m) * 100 >= np.maximum(n, m) * 75
            i, j = np.nonzero(apart)
            if len(i):
                d = _different(sk[x][i], sk[y][j])
                ok = d <= MAX_DIFFERENT
                if ok.any():  # a pair is told in the first of its buckets only
                    ok[ok] = first_key(sym[x][i[ok]], sym[y][j[ok]]) == key[x][i[ok]] >> 48
                i, j = i[ok], j[ok]
                found += zip(cid[x][i].tolist(), cid[y][j].tolist(), lab[x][i].tolist(), lab[y][j].tolist(), d[ok].tolist())
    return found


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is perhaps among ``ids``: tested on a broadcast bitmap, within the JVM."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, ids.count()) - 1).bit_length()))
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    place = ids.select(slot("rep_id").alias("slot"))
    bitmap = place.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    own = docs.withColumn("slot", slot("doc_id"))
    met = own.join(F.broadcast(bitmap), F.bitmap_bucket_number("slot") == F.col("page"))
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(*docs.columns)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first kind of key (chunk and symbol left out) that two rows of key symbols, as bytes, have alike; -1: none."""
    apart = (a.view(np.uint16) != b.view(np.uint16)).reshape(len(a), -1, CHUNK)
    errors = apart.sum(2)
    chunk = (errors <= 1).argmax(1)
    k = np.arange(len(a))
    return np.where(errors[k, chunk] <= 1, chunk * CHUNK + apart[k, chunk].argmax(1), -1)


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """cid and full set of the classes in ``needed`` (cid), made again from the text of a document of each."""
    own = materialise(classes.join(needed, "cid", "left_semi").select("cid", "rep_id", "class"), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "class", "shingles"])

    # a class without any id is found by its digest alone, among the rows without one
    rows = _needed(docs.where(F.col("doc_id").isNotNull()), own.where(F.col("rep_id").isNotNull()).select("rep_id"))
    made = rows.unionByName(docs.where(F.col("doc_id").isNull())).mapInArrow(handing_back(run), "id long, class binary, shingles binary")
    own = own.withColumnRenamed("class", "of")
    made = made.join(own, (F.col("class") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep_id")))
    return materialise(made.groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, min_percent: int) -> DataFrame:
    """The pairs (u, v, lu, lv) whose full sets have 100 * intersection >= min_percent * union: lu, lv as u, v."""
    pairs = materialise(pairs.select("u", "v", "lu", "lv"), "pairs")
    sets = _sets(docs, classes, pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct())
    both = pairs.join(sets.select(F.col("cid").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("cid").alias("v"), F.col("shingles").alias("sv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= min_percent * (len(p) + len(q) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"])

    return both.select("lu", "lv", "su", "sv").mapInArrow(handing_back(run), "u long, v long")


def _labelled(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket rows (key, cid) with the component known so far."""
    if labels is None:
        return met.withColumn("label", F.col("cid"))
    return met.join(labels, met.cid == labels.node, "left").select("key", "cid", F.coalesce("comp", "cid").alias("label"))


def _buckets(rows: DataFrame, round_no: int) -> DataFrame:
    """Of each bucket with several components: a pivot, its component and the number of rows. Pivots follow one of ORDERS orders of
    all classes, others each round, so many buckets with the same members have the same pivot, but not all."""
    order = F.struct(F.xxhash64(F.lit(round_no), F.pmod(F.xxhash64("key"), F.lit(ORDERS)), "cid").alias("o"), "cid", "label")
    seen = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count("*").alias("rows"), F.min(order).alias("p")).where("a < z")
    return seen.select("key", "rows", F.col("p.cid").alias("pivot"), F.col("p.label").alias("big"))


def _merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components of classes, from those known before and the components of these."""
    if old is None:
        return new
    n = new.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    moved = old.join(n, old.comp == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
    return materialise(moved.union(new.join(old.select("node"), "node", "left_anti").select("node", "comp")), "labels")


def linked(docs: DataFrame, min_percent: int = 75, also: list[str] | None = None) -> DataFrame:
    """doc_id, ``also``, n_shingles, component_id, kept and label (the component's number, null for the empty set) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    also = also or []
    with scratch(spark):
        rows = materialise(_digested(docs, also), "digested")
        docs = docs.select("doc_id", "text")
        classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep_id"), F.first("n_shingles").alias("n"), F.first("symbols").alias("symbols"), F.first("sketch").alias("sketch"))
        classes = materialise(classes, "unnumbered").orderBy(F.col("rep_id").asc_nulls_last(), "class")
        classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

        # sets of one or two shingles are near no other set
        filed = classes.where(F.col("n") > 2).select("cid", "symbols").mapInArrow(handing_back(_keys), "key long, cid long")
        met = materialise(filed.repartition("key").sortWithinPartitions("key").mapInArrow(handing_back(_multi), "key long, cid long"), "buckets")
        sketched = classes.select("cid", "n", "sketch")
        labels = None

        for round_no in range(2):
            # four chunks of the sixteen: nearly all pairs at 0.75 share a bucket of theirs, and the others are left to the last step
            own = _labelled(met.where(F.floor(F.shiftright("key", 50) / 4) == round_no), labels)
            stars = own.join(_buckets(own, round_no), "key").where("label <> big").select(F.col("cid").alias("u"), F.col("pivot").alias("v"), F.col("label").alias("lu"), F.col("big").alias("lv")).distinct()
            x, y = (sketched.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "uv")
            close = stars.join(x, "u").join(y, "v").select("nu", "nv", "su", "sv", "u", "v", "lu", "lv").mapInArrow(handing_back(_close), "u long, v long, lu long, lv long, d long")
            best = close.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("place") <= NEAREST)
            labels = _merged(labels, components(_verify(best, docs, classes, min_percent)))

        own = _labelled(met, labels)
        own = materialise(own.join(_buckets(own, 2), "key").select("key", "cid", "label", "rows", (F.col("label") == F.col("big")).alias("in_big")), "rest")
        minor = own.groupBy("key").agg(F.count_if(~F.col("in_big")).alias("minor"))
        blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
        own = own.join(minor, "key").withColumn("g", blocks(F.col("rows") - F.col("minor"))).withColumn("h", blocks(F.col("minor")))
        own = own.withColumn("at", F.pmod(F.xxhash64("cid"), F.when(F.col("in_big"), F.col("g")).otherwise(F.col("h"))).cast("int"))
        groups = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
        place = lambda kind, i, j, side: F.struct(F.xxhash64(F.lit(kind), "key", i, j).alias("gid"), side.cast("int").alias("side"))
        at = F.col("at")
        among = groups(F.col("h"), lambda j: place(1, F.least(at, j), F.greatest(at, j), F.when(at == j, -1).otherwise((at > j).cast("int"))))
        dealt = F.when(F.col("in_big"), groups(F.col("h"), lambda j: place(0, at, j, F.lit(1)))).otherwise(F.concat(groups(F.col("g"), lambda i: place(0, i, at, F.lit(0))), among))
        names = ["gid", "key", "cid", "label", "side", "n", "sketch", "symbols"]
        spread = own.join(classes.select("cid", "n", "sketch", "symbols"), "cid").select("*", F.explode(dealt).alias("x")).select("*", "x.*").select(*names)
        told = pa.schema([(c, pa.int64()) for c in ("u", "v", "lu", "lv", "d")])
        pairs = materialise(spread.repartition("gid").sortWithinPartitions("gid").mapInArrow(handing_back(_grouped(names, _cross, told)), "u long, v long, lu long, lv long, d long"), "cross")
        # the nearest pairs of two components first: where they are linked, the other pairs of theirs need no proof
        apart = Window.partitionBy(F.least("lu", "lv"), F.greatest("lu", "lv")).orderBy("d", "u", "v")
        first = materialise(pairs.withColumn("place", F.row_number().over(apart)).where(F.col("place") <= NEAREST), "first")
        joined = components(_verify(first, docs, classes, min_percent))
        labels = _merged(labels, joined)
        a, b = (joined.select(F.col("node").alias(f"l{c}"), F.col("comp").alias(f"c{c}")) for c in "uv")
        rest = pairs.join(first.select("u", "v"), ["u", "v"], "left_anti").join(a, "lu", "left").join(b, "lv", "left")
        rest = rest.select("u", "v", F.coalesce("cu", "lu").alias("lu"), F.coalesce("cv", "lv").alias("lv")).where("lu <> lv")
        labels = _merged(labels, components(_verify(rest, docs, classes, min_percent)))

        named = materialise(classes.join(labels, classes.cid == labels.node, "left").select("class", F.coalesce("comp", "cid").alias("label")), "named")
        least = classes.select(F.col("cid").alias("label"), F.col("rep_id").alias("component_id"))
        of_class = named.join(least, "label").select(F.col("class").alias("of"), "label", "component_id")
        out = rows.drop("symbols", "sketch").join(of_class, F.col("class") == F.col("of"), "left")
        component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = out.select("doc_id", *also, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "label")
        return materialise(out, "linked", result=True)


def near_duplicates(docs: DataFrame, min_percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return linked(docs, min_percent).drop("label")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
