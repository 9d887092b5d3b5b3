"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent zstd frames, each holding whole WARC records;
then a skippable frame with the record index (page_id, frame, offset inside the
frame, length); then the seek table of the public seekable format as the last
skippable frame.  Decompressing a bundle front to back gives a plain WARC file,
and one record is reached by reading the two tables and one frame.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the
smallest page_id is a ``response`` and the others ``revisit`` it, without payload.

Defined cases: a null html is an empty payload; a null url gives no target URI;
control characters in a url are percent-encoded; rows that repeat the smallest
page_id of a payload are all responses; a null page_id is never the smallest and
is read back as null; an empty table writes no bundle; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, keep, scratch, slices
from .files import new_file, open_file

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
#: Rows of (digest, page_id, url) that may be broadcast.
BROADCAST_FIRSTS = 200_000
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = np.dtype([("page_id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
NO_ID = -(1 << 63)

MANIFEST = "path string, n_records long, n_frames long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(record: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first_url: str | None = None) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit keeps the header only.

    ``record``: a name no other record has.  Page ids stand in fields of their own.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record)}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
        if first_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(first_url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record; raises if lengths or digests don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    if not revisit and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload doesn't match its length or digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"record_id": fields["WARC-Record-ID"], "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_bytes": stated, "payload_digest": digest, "payload": None if revisit else payload}


class BundleWriter:
    """Frames go to the file as they fill up; only the index stays in memory."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        self.index.append((NO_ID if page_id is None else page_id, len(self.sizes), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)

    def _flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self.zstd.compress(np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class Bundle:
    """Random access to the records of one bundle."""

    def __init__(self, uri: str):
        import zstandard

        self.file, self.zstd = open_file(uri), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"no seek table: {uri}")
        entries = np.frombuffer(self._read(size - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.sizes = entries[:, 0]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._read(at, 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError(f"no record index: {uri}")
        self.index = np.frombuffer(self.zstd.decompress(self._read(at + 8, length)), INDEX)
        self._last: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self._last = k, self.zstd.decompress(self._read(int(self.starts[k]), int(self.sizes[k])))
        return self._last[1]

    def record(self, row: np.void) -> bytes:
        return self.frame(int(row["frame"]))[int(row["offset"]) : int(row["offset"]) + int(row["length"])]

    def records(self):
        return (parse_record(self.record(row)) for row in self.index)

    def find(self, page_id: int) -> list[dict]:
        """The records of one page, reading only their frames."""
        return [parse_record(self.record(row)) for row in self.index[self.index["page_id"] == page_id]]


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with payload, sha1 (hex) and refers_to.

    The payloads are grouped by digest as (digest, page_id, url) only; what is joined
    back is one row per payload that occurs more than once.  Up to BROADCAST_FIRSTS
    such rows are broadcast, so that no payload moves; more are joined by a shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count(F.lit(1)).alias("n"))
    firsts = keep(firsts.filter("n > 1").drop("n"), "warc-firsts")
    rows = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_FIRSTS else firsts, "sha1", "left")
    again = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "sha1", F.when(again, F.col("first")).alias("refers_to"), "first_url")


def write_bundles(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the archives; returns their manifest (MANIFEST)."""
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches):
        import pyarrow as pa

        part, number, rows = TaskContext.get().partitionId(), 0, []
        records = ((p, u, b, base64.b32encode(bytes.fromhex(s)).decode(), r, f) for batch in slices(batches) for p, u, b, s, r, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), *(batch.column(c).to_pylist() for c in (3, 4, 5))))
        record = next(records, None)
        while record is not None:
            path = f"{folder}/part-{part:06d}-{number:04d}.warc.zst"
            with new_file(path) as out:
                bundle = BundleWriter(out, frame_bytes)
                while record is not None and (not bundle.total or bundle.total < bundle_bytes):
                    bundle.add(record[0], make_record(f"{path}#{len(bundle.index)}", *record))
                    record = next(records, None)
                bundle.close()
            rows.append({"path": path, "n_records": len(bundle.index), "n_frames": len(bundle.sizes), "n_bytes": bundle.total})
            number += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int64()), ("n_bytes", pa.int64())]))

    return keep(first_pages(pages, least_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives (RECORDS), payloads checked on the way."""

    def read(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [tuple(r[n] for n in names) for r in Bundle(path).records()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(read, RECORDS)
