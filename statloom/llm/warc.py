"""WARC archives with an index: write, select, read back by coalesced byte ranges.

Every page becomes one gzip member of a WARC 1.1 archive in the shared folder. Payloads are compared by SHA-1: of
equal ones that with the smallest page id is a ``response``, the others are ``revisit`` records without the payload.
Which digests repeat is settled by one pre-aggregated pass; a digest that a large part of all pages share is looked
up by broadcast and its pages stay spread.

The writing tasks return the index: archive, offset, length, URL, digest per record. An archive's name holds the
task attempt, and only the index rows of committed attempts are kept, so a lost or repeated attempt leaves at most
a file nobody refers to. Readers take index rows sorted by archive and offset, merge neighbouring ranges up to
``RANGE_BYTES`` into one read, and verify each payload's digest.

Files are read and written through pyarrow's file systems (file, HDFS, S3, GCS by the folder's URI).

Defined results: a null payload counts as empty; a null URL is written as ``about:blank``; pages with a null id are
always responses and never referred to; rows that repeat an id and a payload are all of the same type; payloads of
fewer than ``min_revisit_bytes`` are all responses; other columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_lookup, tidy, work_dir, written

#: An archive is closed once it is this long, and the task goes on with another.
ARCHIVE_BYTES = 256 << 20
#: Ranges with no more than GAP_BYTES between them are read as one, up to RANGE_BYTES.
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id {kind}, record_type string, refers_to {kind}, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id, url: str | None, payload: bytes | None, size: int, sha: str, refers_to=None) -> bytes:
    """One record; payload None makes it a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _open(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path


class _Writer:
    """Archives of one task, each closed at ARCHIVE_BYTES."""

    def __init__(self, folder: str):
        self.fs, self.path = _open(folder)
        self.fs.create_dir(self.path, recursive=True)
        t = TaskContext.get()
        self.stem = f"part-{t.partitionId():06d}-{t.taskAttemptId()}"
        self.n, self.out, self.at, self.name = 0, None, 0, ""

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name = f"{self.stem}-{self.n:04d}.warc.gz"
            self.out, self.at, self.n = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, self.n + 1
        begin = self.at
        self.out.write(member)
        self.at += len(member)
        return self.name, begin

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The record of each page as a response, compressed, before anything is shuffled."""
    for batch in batches:
        rows, size = [], 0
        for page_id, url, html in zip(batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            sha = hashlib.sha1(payload)
            member = _gzip(record(page_id.as_py(), url.as_py(), payload, len(payload), base64.b32encode(sha.digest()).decode()))
            rows.append((page_id.as_py(), url.as_py(), sha.hexdigest(), len(payload), member))
            size += len(member)
            if size > BATCH_BYTES:
                yield _table(rows, batch.schema.field("page_id").type)
                rows, size = [], 0
        if rows:
            yield _table(rows, batch.schema.field("page_id").type)


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=["page_id", "url", "sha", "payload_bytes", "member"])


def _archive(folder: str):
    def run(batches):
        writer = _Writer(folder)
        for batch in batches:
            out = []
            for r in batch.select([n for n in batch.schema.names if n != "member"]).to_pylist():
                sha = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                out.append((r, sha))
            index = []
            for (r, sha), member in zip(out, batch.column("member"), strict=True):
                refers = r["refers_to"]
                data = member.as_py() if refers is None else _gzip(record(r["page_id"], r["url"], None, r["payload_bytes"], sha, refers))
                name, offset = writer.add(data)
                index.append((name, offset, len(data), r["url"], sha, r["page_id"], "response" if refers is None else "revisit", refers, r["payload_bytes"]))
            kind = batch.schema.field("page_id").type
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind, pa.string(), kind, pa.int64()]
            names = ["archive", "offset", "length", "url", "payload_digest", "page_id", "record_type", "refers_to", "payload_bytes"]
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=names)
        writer.close()

    return run


def write_archives(pages: DataFrame, *, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> tuple[str, DataFrame]:
    """The archives' folder, and the index that the writing tasks returned, stored as Parquet."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    repeated = rows.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes).groupBy(F.sha1(payload).alias("sha")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    repeated = written(repeated, spark, "warc-repeated")
    prepared = rows.mapInArrow(tidy(_prepare), f"page_id {kind}, url string, sha string, payload_bytes long, member binary")
    placed = skew_lookup(prepared, repeated, "sha", ["refers_to"], "copies", ["page_id"])
    placed = placed.withColumn("refers_to", F.when((F.col("payload_bytes") >= min_revisit_bytes) & (F.col("page_id") > F.col("refers_to")), F.col("refers_to")))
    index = placed.mapInArrow(tidy(_archive(folder)), INDEX.format(kind=kind))
    return folder, written(index, spark, "warc-index")


def read_records(folder: str, selected: DataFrame) -> DataFrame:
    """url, payload_digest (computed again), payload_bytes, payload, record_type, page_id, refers_to of index rows ``selected``.

    A revisit has no payload of its own; its digest and length are those its record states.
    """
    kind = dict(selected.dtypes)["page_id"]
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = selected.select("archive", "offset", "length", "page_id", "refers_to").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(tidy(_read(folder)), f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def _read(folder: str):
    def run(batches):
        fs, path = _open(folder)
        for batch in batches:
            todo: list[dict] = []
            for r in batch.to_pylist():
                if todo and (r["archive"] != todo[0]["archive"] or r["offset"] > todo[-1]["offset"] + todo[-1]["length"] + GAP_BYTES or r["offset"] + r["length"] - todo[0]["offset"] > RANGE_BYTES):
                    yield from _range(fs, path, todo, batch.schema.field("page_id").type)
                    todo = []
                todo.append(r)
            if todo:
                yield from _range(fs, path, todo, batch.schema.field("page_id").type)

    return run


def _range(fs, path: str, todo: list[dict], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    first, last = todo[0], todo[-1]
    with fs.open_input_file(f"{path}/{first['archive']}") as f:
        data = f.read_at(last["offset"] + last["length"] - first["offset"], first["offset"])
    out, size = [], 0
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary()]

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for r in todo:
        at = r["offset"] - first["offset"]
        fields, http, payload = parse(zlib.decompress(data[at : at + r["length"]], 31))
        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        response = fields["WARC-Type"] == "response"
        if response and digest(payload) != told:
            raise ValueError(f"damaged record at {r['archive']}:{r['offset']}")
        out.append((r["page_id"], fields["WARC-Target-URI"], len(payload) if response else int(http["Content-Length"]), told, fields["WARC-Type"], r["refers_to"], payload if response else None))
        size += len(payload)
        if size > BATCH_BYTES:
            yield made()
            out, size = [], 0
    if out:
        yield made()
