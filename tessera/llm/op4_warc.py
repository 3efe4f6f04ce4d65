"""WARC records in ZIP archives: written as stored members with an index, read back by ranges.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (a line a record, with offset and length). The reader never extracts: it reads the end of the file,
the central directory (ZIP64 where the plain fields are full) and a member's local header, then the index, and then only
the ranges of the records. Archives lie in the folder of ``spark.checkpoint.dir`` and are opened through
``pyarrow.fs``, so any store that it knows will do; a task that is run again writes under a new name, and only names in
the manifest are read.

Edge cases: a null html is an empty payload; a null url leaves out the target; null ids: a record with a null page_id is never
the one that others revisit, revisits it itself where an equal payload has an id, and is a response otherwise; repeated
rows with the smallest page_id are all responses; an empty table gives no archives and an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, new_path, pieces, scratch, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 16_000_000
RANGE_BYTES = 1_000_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which has the length of the full payload, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    of = lambda s: int(s[10:-1]) if s and s[10:-1] else None  # noqa: E731  <urn:page:N>
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its header says")
    return {"page_id": of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": of(fields.get("WARC-Refers-To"))}


def gzip_member(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file: where the bytes of each begin, and how many. ``read(offset, length)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail_at + at - 20
        mark, _, end64, _ = struct.unpack("<4sIQI", read(locator, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(end64, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n, extra, comment, header = (*struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<IIHHH", directory, at + 20), *struct.unpack_from("<I", directory, at + 42))
        name = directory[at + 46 : at + 46 + n].decode()
        more, i = directory[at + 46 + n : at + 46 + n + extra], 0
        while i + 4 <= len(more):
            kind, width = struct.unpack_from("<HH", more, i)
            if kind == 1:  # the ZIP64 values, of those fields only that are full
                wide = list(struct.unpack_from(f"<{width // 8}Q", more, i + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            i += 4 + width
        if method != 0:
            raise ValueError(f"{name} is not stored but packed: its records can't be read by ranges")
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        a, b = struct.unpack_from("<HH", local, 26)
        found[name] = (header + 30 + a + b, packed)
        at += 46 + n + extra + comment
    return found


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives below ``folder``; the manifest: archive, records. It is a table by then."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = own.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    own = own.join(groups.select("sha", "first_id"), "sha", "left").select("page_id", "url", "payload", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        data, lines = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
                for member, raw in ((DATA, data.getvalue()), (INDEX, "\n".join(lines).encode())):
                    with z.open(zipfile.ZipInfo(member), "w", force_zip64=True) as f:
                        f.write(raw)
            with store.open_output_stream(name) as f:
                f.write(buffer.getvalue())
            n = len(lines)
            data.seek(0)
            data.truncate()
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([name.removeprefix(base + "/")]), pa.array([n], pa.int64())], names=["archive", "records"])

        for b in pieces(batches):
            for page_id, url, body, first in zip(*(c.to_pylist() for c in b.columns)):
                revisit = first is not None and page_id != first
                digest = digest32(body)
                raw = gzip_member(record(page_id, url, body, digest, first if revisit else None, revisit))
                lines.append(json.dumps({"url": url, "page": page_id, "offset": data.tell(), "length": len(raw), "digest": f"sha1:{digest}", "filename": DATA}))
                data.write(raw)
                if data.tell() > ARCHIVE_BYTES:
                    yield close()
        if lines:
            yield close()

    return materialise(own.mapInArrow(run, "archive string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the archives of a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive (and payload)."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in pieces(batches):
            rows: list[tuple] = []
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    read = lambda at, n: f.read_at(n, at)
                    found = members(read, f.size())
                    data, _ = found[DATA]
                    at, size = found[INDEX]
                    group: list[int] = []
                    for line in read(at, size).splitlines():
                        x = json.loads(line)
                        if not group:
                            first = data + x["offset"]
                        group.append(x["length"])
                        if sum(group) >= RANGE_BYTES:
                            rows.append((name, first, group))
                            group = []
                    if group:
                        rows.append((name, first, group))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "start_at", "lengths"])

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if payloads:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in pieces(batches):
            for name, first, lengths in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(f"{base}/{name}") as f:
                    raw = f.read_at(sum(lengths), first)
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)] + [pa.array([name] * len(rows))], names=[*names, "archive"])

    found = manifest.select("archive").repartition("archive").mapInArrow(ranges, "archive string, start_at long, lengths array<long>")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads + ", archive string"
    return found.repartition("archive", "start_at").mapInArrow(records, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        folder = new_path(spark, "archives")
        found = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)
        return materialise(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records", result=True)
