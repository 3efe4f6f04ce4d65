"""Merkle manifest of a dataset: a tree of fan-out 8 for each group, a tree over the groups' roots, proofs for every row.

Rows become leaves (sha256 over length-prefixed fields) and are range-partitioned in order. A partition knows the index of
its first leaf, so it runs a mountain-range stack: leaves are pushed, a run of eight is hashed into its parent as soon as
it is full (a carry in base 8), and the last run of a level is hashed as short as it is, without padding. Runs that begin
or end in another partition stay as peaks: at most seven a level at each end. Those edges are merged level by level in
groups of at most eight, so no task sees more than its rows and a few peaks, and the tree's height is the number of rounds.

Proofs go the other way: the steps of the nodes at level ``BLOCK`` are joined from the root down, then each block of
8**BLOCK leaves, which holds its own lower levels, folds its rows in one task.

Edge cases: a null field is ``-``; null groups come first, null keys first within a group; repeated rows are leaves of their
own, rows with the same key are ordered by their leaf; a null doc_id is never tampered with; an empty table has no root
and gives an empty table; columns that are not named as fields are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, crc32_sql, materialise, scratch, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, BITS = 8, 3
#: Levels that a task of the proofs folds by itself: blocks of 8**4 leaves.
BLOCK = 4
STEPS = "array<struct<at: int, others: array<binary>>>"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field ``-`` if null, else its bytes with their number in front."""
    as_text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in as_text]).cast("binary"), 256))


def leaves(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """grp, key, leaf, tampered: groups as text that sorts nulls first; ``tampered`` is another digest of the row, or null."""
    g = F.col(f"`{group}`").cast("string")
    grp = F.when(g.isNull(), "0").otherwise(F.concat(F.lit("1"), g))
    return docs.select(grp.alias("grp"), F.col(f"`{key}`").alias("key"), leaf_of([F.col(f"`{f}`") for f in fields]).alias("leaf"), (F.lit(None).cast("binary") if tampered is None else tampered).alias("tampered"))


def height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _height(n: Column) -> Column:
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda i: n > F.pow(F.lit(float(FANOUT)), i)))


def indexed(rows: DataFrame) -> DataFrame:
    """The rows in the order of (grp, key, leaf), each with its partition, its index within its group and the group's size."""
    # the salt tells repeated rows apart, so that a range can end between them
    salted = materialise(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    order = ["grp", "key", "leaf", "salt"]
    placed = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.shiftright("at", 33)), "placed")
    each = placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    by_group = Window.partitionBy("grp")  # a row for each partition that the group reaches into
    before = F.coalesce(F.sum("c").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = materialise(each.select("part", "grp", "first", before.alias("start"), F.sum("c").over(by_group).alias("n")), "segments")
    return placed.join(segments, ["part", "grp"]).select("part", "grp", (F.col("at") - F.col("first") + F.col("start")).alias("idx"), "n", "key", "leaf", "tampered")


class Mountains:
    """The stack of one segment: nodes from leaf ``start`` on of a tree with ``n`` leaves, pushed in order."""

    def __init__(self, n: int):
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.runs: list[list[bytes]] = [[] for _ in self.sizes]
        self.first = [0] * len(self.sizes)
        self.out: list[tuple[int, int, bytes, bool]] = []  # level, index, digest, peak

    def push(self, level: int, idx: int, digest: bytes) -> None:
        while True:
            run = self.runs[level]
            if not run:
                self.first[level] = idx
            run.append(digest)
            if level + 1 == len(self.sizes) or (idx % FANOUT != FANOUT - 1 and idx + 1 != self.sizes[level]):
                return
            if self.first[level] % FANOUT:  # the run began in an earlier partition
                self._peaks(level)
                return
            if level:
                self.out += [(level, self.first[level] + i, d, False) for i, d in enumerate(run)]
            digest = hashlib.sha256("".join(d.hex() for d in run).encode()).digest()
            run.clear()
            level, idx = level + 1, idx // FANOUT

    def _peaks(self, level: int) -> None:
        self.out += [(level, self.first[level] + i, d, True) for i, d in enumerate(self.runs[level])]
        self.runs[level].clear()

    def close(self) -> None:
        for level in range(len(self.sizes)):
            self._peaks(level)


NODES = "grp string, n long, level int, idx long, digest binary, peak boolean"


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node records and peaks of the segments of a partition, whose rows come in order."""
    now, range_, names = None, None, ["grp", "n", "level", "idx", "digest", "peak"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]

    def flush():
        grp, n = now[1], range_.sizes[0]
        rows, range_.out = range_.out, []
        columns = list(zip(*[(grp, n, *r) for r in rows])) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    for b in batches:
        for part, grp, idx, n, leaf in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (part, grp) != now:
                if now is not None:
                    range_.close()
                    yield flush()
                now, range_ = (part, grp), Mountains(n)
            range_.push(0, idx, leaf)
            if len(range_.out) >= 10_000:
                yield flush()
    if now is not None:
        range_.close()
        yield flush()


@dataclass
class Tree:
    """rows: grp, idx, n, key, leaf, tampered; nodes: grp, n, level, idx, digest, peak, with all levels from 1 on."""

    rows: DataFrame
    nodes: DataFrame
    roots: DataFrame  #: grp, n, subroot
    top: int  #: height of the largest tree


def tree(rows: DataFrame) -> Tree:
    """Trees of all groups of ``rows`` (grp, key, leaf, tampered)."""
    rows = indexed(rows)
    in_order = rows.select("part", "grp", "idx", "n", "leaf").repartition("part").sortWithinPartitions("part", "grp", "idx")
    stacked = materialise(in_order.mapInArrow(_stack, NODES), "nodes")
    top = height(stacked.agg(F.max("n")).first()[0] or 0)
    peaks = stacked.where("peak")
    merged, levels = None, []
    hex_of = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k["digest"]))), "")
    for level in range(top):
        at = peaks.where(F.col("level") == level).drop("peak")
        at = (at if merged is None else at.unionByName(merged)).where(_height(F.col("n")) > level)
        runs = at.groupBy("grp", "n", F.shiftright("idx", BITS).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        merged = materialise(runs.select("grp", "n", F.lit(level + 1).alias("level"), "idx", F.unhex(F.sha2(hex_of.cast("binary"), 256)).alias("digest")), "merged")
        levels.append(merged.withColumn("peak", F.lit(True)))
    nodes = stacked
    for m in levels:
        nodes = nodes.unionByName(m)
    roots = nodes.where((F.col("idx") == 0) & (F.col("level") == _height(F.col("n")))).select("grp", "n", F.col("digest").alias("subroot"))
    return Tree(rows, nodes, materialise(roots, "roots"), top)


def steps_down(nodes: DataFrame, seeds: DataFrame, top: int, lowest: int) -> DataFrame:
    """grp, idx, steps of the nodes at level ``lowest``: position and siblings on each level up to the seeds (grp, level, steps)."""
    known = None
    for level in range(top, lowest - 1, -1):
        seed = seeds.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "steps")
        if known is not None:
            kids = nodes.where(F.col("level") == level).groupBy("grp", F.shiftright("idx", BITS).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
            each = kids.join(known.select("grp", F.col("idx").alias("up"), "steps"), ["grp", "up"]).select("grp", "steps", "kids", F.posexplode("kids").alias("at", "kid"))
            others = F.filter("kids", lambda k: k["idx"] != F.col("kid.idx"))
            step = F.struct(F.col("at").cast("int").alias("at"), F.transform(others, lambda k: k["digest"]).alias("others"))
            seed = seed.unionByName(each.select("grp", F.col("kid.idx").alias("idx"), F.concat(F.array(step), "steps").alias("steps")))
        known = materialise(seed, "steps")
    return known


def fold(leaf: str, proof: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf and its proof (position and the other nodes of its run, from the leaf up) lead to."""
    for at, others in proof:
        leaf = H(*others[:at], leaf, *others[at:])
    return leaf


def _folder(with_proof: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, rows = None, None, []

        def block() -> pa.RecordBatch:
            above = [(s["at"], [d.hex() for d in s["others"]]) for s in head["steps"]]
            subroot, root = head["subroot"].hex(), head["root"].hex()
            runs, nodes = [], [leaf.hex() for _, _, leaf, _ in rows]  # a text for each run of each level
            for _ in range(min(BLOCK, height(head["n"]))):
                runs.append(["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
                nodes = [H(r) for r in runs[-1]]
            if len(nodes) != 1 or fold(nodes[0], above) != root:
                raise ValueError("the manifest does not belong to these rows")
            tail = "".join("".join(o) for _, o in above)
            out: list[tuple] = []
            for i, (_, key, leaf, tampered) in enumerate(rows):
                own, at, siblings, proof = (leaf if tampered is None else tampered).hex(), i, [], []
                for level in runs:
                    r, k = level[at // FANOUT], 64 * (at % FANOUT)
                    left, right = r[:k], r[k + 64 :]
                    own = H(left, own, right)
                    siblings += [left, right]
                    if with_proof:
                        proof.append({"at": at % FANOUT, "others": [(left + right)[j : j + 64] for j in range(0, len(left) + len(right), 64)]})
                    at //= FANOUT
                own = fold(own, above)
                row = (key, leaf.hex(), subroot, root, H(*siblings, tail), own, own == root)
                out.append((*row, [*proof, *({"at": a, "others": o} for a, o in above)]) if with_proof else row)
            types = [key_type, *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))] * with_proof]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * with_proof])

        for b in batches:
            key_type = b.schema.field("key").type
            for grp, blk, idx, key, leaf, tampered, h in zip(*(b.column(c).to_pylist() for c in ("grp", "block", "idx", "key", "leaf", "tampered", "head"))):
                if (grp, blk) != now:
                    if rows:
                        yield block()
                    now, head, rows = (grp, blk), h, []
                else:
                    rows.append((idx, key, leaf, tampered))
        if rows:
            yield block()

    return run


def proofs(rows: DataFrame, with_proof: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for rows of ``leaves``.

    ``folded_root`` starts from ``tampered`` where there is one. ``with_proof`` adds the proof itself, as ``fold`` takes it.
    """
    lower = tree(rows)
    over = tree(lower.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("tampered")))
    none = F.array().cast(STEPS)
    level_0 = over.rows.select("grp", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), F.lit(True).alias("peak"))
    over_nodes = over.nodes.where("level > 0").unionByName(level_0)
    over_steps = steps_down(over_nodes, over.roots.select("grp", _height(F.col("n")).alias("level"), none.alias("steps")), over.top, 0)
    named = over.rows.join(over_steps, ["grp", "idx"]).select(F.col("key").alias("grp"), "steps")
    root = over.roots.first()  # one digest, or none of an empty table
    groups = materialise(lower.roots.join(named, "grp").withColumn("root", F.lit(bytes(root["subroot"]) if root else None).cast("binary")), "groups")
    seeds = groups.select("grp", F.greatest(_height(F.col("n")), F.lit(BLOCK)).alias("level"), "steps")
    blocks = steps_down(lower.nodes, seeds, max(lower.top, BLOCK), BLOCK)
    head = F.struct("n", "subroot", "root", F.col("steps"))
    heads = blocks.join(groups.drop("steps"), "grp").select("grp", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit(None).alias("key"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("tampered"), head.alias("head"))
    own = lower.rows.select("grp", F.shiftright("idx", BITS * BLOCK).alias("block"), "idx", "key", "leaf", "tampered")
    key_type = dict(own.dtypes)["key"]
    both = own.withColumn("head", F.lit(None).cast(heads.schema["head"].dataType)).unionByName(heads.withColumn("key", F.col("key").cast(key_type)))
    schema = f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<struct<at: int, others: array<string>>>" if with_proof else "")
    return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx").mapInArrow(_folder(with_proof), schema)


def manifest(docs: DataFrame, with_proof: bool = False) -> DataFrame:
    """The contract's rows: every document a leaf, a third of them proven with tampered text."""
    changed = [ascii_lower(F.col("text")) if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_of(changed))
    return proofs(leaves(docs, tampered=tampered), with_proof).withColumnRenamed("key", "doc_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return materialise(manifest(table(spark, sf_dir, "documents")), "proofs", result=True)


def oracle_sql() -> str:
    def text(f: str, value: str) -> str:
        return f"case when {f} is null then '-' else octet_length(encode(cast({value} as varchar))) || ':' || {value} end"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = " || ".join(text(f, f) for f in FIELDS)
    changed = " || ".join(text(f, lower if f == "text" else f) for f in FIELDS)

    def levels(name: str, leaves: str) -> str:
        return f"""{name} as (
      select grp, 0 as level, idx, digest, n from {leaves}
      union all
      select grp, level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 7) // 8 from {name} where n > 1 group by grp, level, idx // 8
    ), {name}_runs as (
      select grp, level, idx // 8 as run, list(digest order by idx) as kids from {name} where n > 1 group by grp, level, idx // 8
    )"""

    def folded(name: str, start: str, tree: str) -> str:
        return f"""{name} as (
      select row, grp, 0 as level, idx, own, siblings from {start}
      union all
      select f.row, f.grp, f.level + 1, f.idx // 8, sha256(array_to_string(r.kids[: f.idx % 8], '') || f.own || array_to_string(r.kids[f.idx % 8 + 2 :], '')),
        f.siblings || array_to_string(r.kids[: f.idx % 8], '') || array_to_string(r.kids[f.idx % 8 + 2 :], '')
      from {name} f join {tree}_runs r on f.grp = r.grp and f.level = r.level and f.idx // 8 = r.run
    ), {name}_end as (
      select row, arg_max(own, level) as own, arg_max(siblings, level) as siblings from {name} group by row
    )"""

    return f"""
    with recursive rows as (
      select doc_id, case when lang is null then '0' else '1' || lang end as grp, sha256({own}) as leaf,
        case when doc_id is not null and ({crc32_sql("cast(doc_id as varchar)")}) % 3 = 0 then sha256({changed}) else sha256({own}) end as shown
      from documents
    ), leaves as (
      select *, row_number() over () as row, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by grp) as n, leaf as digest from rows
    ), {levels("lower", "leaves")}, groups as (
      select grp as name, '' as grp, digest, row_number() over (order by encode(grp)) - 1 as idx, count(*) over () as n from lower where n = 1
    ), {levels("over_", "groups")}, start as (
      select row, grp, idx, shown as own, '' as siblings from leaves
    ), {folded("one", "start", "lower")}, middle as (
      select e.row, '' as grp, g.idx, e.own, e.siblings from one_end e join leaves l on e.row = l.row join groups g on l.grp = g.name
    ), {folded("two", "middle", "over_")}
    select l.doc_id, l.leaf, g.digest as subroot, r.digest as root, sha256(e.siblings) as proof_sha256, e.own as folded_root, e.own = r.digest as verified
    from leaves l join groups g on l.grp = g.name join two_end e on l.row = e.row, (select digest from over_ where n = 1) r"""
