"""WARC records in ZIP-packaged archives: written once, then range-read in place.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member a record)
and ``indexes/index.cdxj``. The reader parses the end record, the ZIP64 end record and locator, the central directory and each
local header itself; finds records through the index; and reads byte ranges of them. Nothing is extracted.

Records with equal payloads: the smallest page_id is a response, the others revisit it (header only, no payload); payloads
below ``min_revisit_bytes`` are always responses. A null payload counts as empty. Rows that repeat the smallest page_id
are responses too; null ids come after all others, so they revisit, or are responses where no id is known. A null url
becomes ``urn:page:<id>``. No pages, no archives and no rows. Other columns are not read.

Tasks write archives under names of their own into the shared folder, and only those in the written manifest count, so a
task that runs twice leaves an unused file and no double record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the formats.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with or without a scheme; executors reach the shared folder by it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def members(f, size: int) -> list[Member]:
    """The central directory of a ZIP or ZIP64 file of ``size`` bytes; ``f`` has seek and read."""

    def at(start: int, n: int) -> bytes:
        f.seek(start)
        got = f.read(n)
        if len(got) != n:
            raise ValueError("ZIP file cut short")
        return got

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(EOCD)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(EOCD, 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    if (n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail_at + k >= 20:
        loc = at(tail_at + k - 20, 20)
        if loc[:4] == LOCATOR64:
            end64 = at(struct.unpack_from("<Q", loc, 8)[0], 56)
            if end64[:4] != EOCD64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, i, out = at(start, length), 0, []
    for _ in range(n):
        if directory[i : i + 4] != CENTRAL:
            raise ValueError("central directory is damaged")
        method, = struct.unpack_from("<H", directory, i + 10)
        stored, full, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, i + 20)
        header, = struct.unpack_from("<I", directory, i + 42)
        name = directory[i + 46 : i + 46 + name_n].decode("utf-8")
        extra, e = directory[i + 46 + name_n : i + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only the values that do not fit above, in this order
                p = e + 4
                if full == 0xFFFFFFFF:
                    (full,), p = struct.unpack_from("<Q", extra, p), p + 8
                if stored == 0xFFFFFFFF:
                    (stored,), p = struct.unpack_from("<Q", extra, p), p + 8
                if header == 0xFFFFFFFF:
                    (header,), p = struct.unpack_from("<Q", extra, p), p + 8
            e += 4 + m
        out.append(Member(name, method, full, stored, header))
        i += 46 + name_n + extra_n + note_n
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin, from its local header."""
    if member.method:
        raise ValueError(f"{member.name} is compressed by the ZIP file; only stored members can be read by range")
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record, not compressed. ``refers_to`` is the page_id of the response, or None for a response."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers by lower-case name, the HTTP headers under ``http``, and the payload that the record holds."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    fields["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}
    fields["payload"] = payload
    return fields


class _Sink:
    """Write-only, so that the ZIP writer never seeks: object stores cannot."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


class ArchiveWriter:
    def __init__(self, folder: str):
        self.path = f"{folder}/part-{uuid.uuid4().hex}.wacz"
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        self._stream = fs.open_output_stream(f"{path}/{self.path.rpartition('/')[2]}")
        self._zip = zipfile.ZipFile(_Sink(self._stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self._index: list[bytes] = []
        self.bytes = 0

    def add(self, raw: bytes, page_id, kind: str) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self._data.write(packed)
        self._index.append(f"urn:page:{page_id} {json.dumps({'offset': self.bytes, 'length': len(packed), 'type': kind, 'filename': DATA})}\n".encode())
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self._data.close()
        with self._zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for line in self._index:
                f.write(line)
        self._zip.close()
        self._stream.close()
        return self.path, len(self._index)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row of ``pages(page_id, url, html)`` and returns the manifest (path, records), itself written down."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    # Joined by another expression than grouped by, so that both sides are dealt out for the join and a hot payload's rows can be split.
    rows = rows.withColumn("k", F.reverse("sha")).join(first.select(F.reverse("sha").alias("k"), "first"), "k").drop("k")
    revisit = ~F.col("first").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= min_revisit_bytes)
    rows = rows.select("page_id", "url", "payload", "sha", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for batch in common.slices(batches, "payload"):
            for r in batch.to_pylist():
                writer = writer or ArchiveWriter(folder)
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                raw = record(r["page_id"], r["url"], r["payload"], digest, r["refers_to"], date)
                writer.add(raw, r["page_id"], "response" if r["refers_to"] is None else "revisit")
                if writer.bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return common.materialize(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


def record_ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of neighbouring records (path, start, lengths), found through directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = open_fs(uri)
                out: list[tuple[int, list[int]]] = []
                with fs.open_input_file(path) as f:
                    by_name = {m.name: m for m in members(f, f.size())}
                    base, index = data_start(f, by_name[DATA]), data_start(f, by_name[INDEX])
                    f.seek(index)
                    total = range_bytes
                    for line in f.read(by_name[INDEX].size).splitlines():
                        at = json.loads(line.partition(b" ")[2])
                        if total + at["length"] > range_bytes:
                            out.append((base + at["offset"], []))
                            total = 0
                        out[-1][1].append(at["length"])
                        total += at["length"]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(out), pa.string()), pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.list_(pa.int32()))], names=["path", "start", "lengths"])

    return manifest.select("path").repartition(common.partitions(manifest.sparkSession)).mapInArrow(run, "path string, start long, lengths array<int>")


def _page(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "None" else int(value)


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_records(ranges: DataFrame) -> DataFrame:
    """Range-reads records; a response's payload must have the length and digest that its headers give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = open_fs(r["path"])
                with fs.open_input_file(path) as f:
                    f.seek(r["start"])
                    data = f.read(sum(r["lengths"]))
                out, at = [], 0
                for n in r["lengths"]:
                    x = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    size, digest = int(x["http"]["content-length"]), x["warc-payload-digest"].removeprefix("sha1:")
                    if x["warc-type"] == "response" and (len(x["payload"]) != size or base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != digest):
                        raise ValueError(f"the payload of {x['warc-record-id']} is damaged")
                    out.append((_page(x["warc-record-id"]), size, digest, x["warc-type"], _page(x["warc-refers-to"]) if "warc-refers-to" in x else None, x["warc-target-uri"]))
                cols = zip(*out) if out else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return ranges.repartition(common.partitions(ranges.sparkSession)).mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives into the shared folder and returns what reading them back gives."""
    folder = common.new_path(pages.sparkSession, "warc")
    return read_records(record_ranges(write_archives(pages, folder, min_revisit_bytes)))
