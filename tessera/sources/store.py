"""A keyed table in files: insert-if-absent, upsert, retention by size, each an atomic new version.

Rows lie in buckets by a hash of their key. A write reads the buckets that its batch touches, merges, writes them anew next
to the old ones, and commits last, by creating the next manifest: a small file that names the folder of each bucket. A
writer that dies before leaves the old version as it was; of two that race, the second one's commit fails. A batch with
an id that was applied already changes nothing, so replays after a failure are safe.

Rows with a null key are not stored. Of rows with the same key in one batch the first by ``order`` counts for an insert; an
upsert merges all of them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Manifest:
    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)  #: bucket: folder
    applied: dict[str, int] = field(default_factory=dict)  #: source: id of the last batch


class CapacityError(ValueError):
    """A batch would take the store beyond its capacity; nothing of it was written."""


class KeyedStore:
    """A store at ``path`` with rows of ``schema`` (DDL); ``key`` is one of its columns. The number of buckets is fixed at the first write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.n = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)
        self._fs = lambda at: at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> Manifest:
        """The newest version."""
        folder = self._at("manifests")
        fs = self._fs(folder)
        if not fs.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
        if not names:
            return Manifest()
        stream = fs.open(self._at(f"manifests/{max(names)}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Manifest(**json.loads(text))

    def _commit(self, m: Manifest) -> None:
        at = self._at(f"manifests/{m.version:012}.json")
        stream = self._fs(at).create(at, False)  # fails where another writer has made this version
        stream.write(bytearray(json.dumps(m.__dict__).encode()))
        stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def read(self, m: Manifest | None = None, buckets: list[str] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of a version."""
        m = self.manifest() if m is None else m
        folders = sorted({f"{self.path}/{folder}/bucket={b}" for b, folder in m.buckets.items() if buckets is None or b in buckets})
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys (one column, named as the key): only their buckets are read."""
        own = keys.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        touched = [str(r[0]) for r in own.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
        return self.read(buckets=touched).join(own, self.key, "left_semi")

    def _write(self, rows: DataFrame, m: Manifest, touched: list[str], source: str | None, batch_id: int | None) -> Manifest:
        folder = f"data/{uuid.uuid4().hex}"
        made = rows.select(*self.schema.names).withColumn("bucket", self._bucket())
        made.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        at = self._at(folder)
        present = {s.getPath().getName().split("=")[1] for s in self._fs(at).listStatus(at) if s.getPath().getName().startswith("bucket=")}
        kept = {b: f for b, f in m.buckets.items() if b not in touched} | {b: folder for b in present}
        new = Manifest(m.version + 1, kept, m.applied | ({source: batch_id} if source is not None else {}))
        self._commit(new)
        return new

    def _batch(self, batch: DataFrame, m: Manifest, source: str, batch_id: int | None) -> tuple[DataFrame, list[str]] | None:
        if batch_id is not None and batch_id <= m.applied.get(source, -1):
            return None
        own = batch.where(F.col(self.key).isNotNull())
        return own, [str(r[0]) for r in own.select(self._bucket()).distinct().collect()]

    def put(self, batch: DataFrame, order: list[str], source: str = "", batch_id: int | None = None, size: str | None = None, capacity: int | None = None) -> Manifest:
        """Insert the rows whose key is absent; rows that are there stay as they are. Beyond ``capacity`` (sum of ``size``) nothing is written."""
        m = self.manifest()
        found = self._batch(batch, m, source, batch_id)
        if found is None:
            return m
        own, touched = found
        first = Window.partitionBy(self.key).orderBy(*order)
        new = own.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").select(*self.schema.names)
        old = self.read(m, touched)
        new = new.join(old.select(self.key), self.key, "left_anti").select(*self.schema.names)
        if capacity is not None:
            total = self.read(m).select(size).unionByName(new.select(size)).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
            if total > capacity:
                raise CapacityError(f"{total} of {capacity}")
        return self._write(old.unionByName(new), m, touched, source, batch_id)

    def upsert(self, batch: DataFrame, merge: dict[str, Column], source: str = "", batch_id: int | None = None) -> Manifest:
        """Merge rows by key: ``merge`` has an aggregate for each further column, over stored and new rows alike."""
        m = self.manifest()
        found = self._batch(batch, m, source, batch_id)
        if found is None:
            return m
        own, touched = found
        both = self.read(m, touched).unionByName(own.select(*self.schema.names))
        return self._write(both.groupBy(self.key).agg(*[c.alias(n) for n, c in merge.items()]), m, touched, source, batch_id)

    def compact(self, capacity: int, size: str, order: str, grain: Column) -> Manifest:
        """Drop the oldest rows (by ``order`` and key) until the sum of ``size`` is at most ``capacity``; all are kept if it is.

        ``grain`` is a coarse form of ``order`` (a day of a time): sizes are summed by grain, and only the grain in which the limit falls is sorted.
        """
        m = self.manifest()
        rows = self.read(m).withColumn("_g", grain)
        sums = Window.orderBy(F.desc_nulls_last("_g")).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each grain
        newer = rows.groupBy("_g").agg(F.sum(size).alias("_s")).withColumn("_newer", F.coalesce(F.sum("_s").over(sums), F.lit(0)))
        if newer.where(F.col("_newer") + F.col("_s") > capacity).isEmpty():
            return m
        placed = rows.join(newer.where(F.col("_newer") < capacity), rows["_g"].eqNullSafe(newer["_g"])).drop(newer["_g"])
        whole = placed.where(F.col("_newer") + F.col("_s") <= capacity)
        edge = placed.where(F.col("_newer") + F.col("_s") > capacity)  # one grain
        up_to = Window.partitionBy("_g").orderBy(F.desc_nulls_last(order), F.desc(self.key)).rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("_at", F.sum(size).over(up_to)).where(F.col("_newer") + F.col("_at") <= capacity)
        kept = whole.select(*self.schema.names).unionByName(edge.select(*self.schema.names))
        return self._write(kept, m, list(m.buckets), None, None)

    def vacuum(self) -> int:
        """Delete folders that the newest version doesn't name, and older manifests; how many. Not beside a running writer or a reader of an older version."""
        m, gone = self.manifest(), 0
        for folder, keep in (("data", {f.split("/")[1] for f in m.buckets.values()}), ("manifests", {f"{m.version:012}.json"})):
            at = self._at(folder)
            fs = self._fs(at)
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if s.getPath().getName() not in keep:
                    gone += fs.delete(s.getPath(), True)
        return gone
