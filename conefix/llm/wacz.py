"""WARC records in ZIP packages, read by byte ranges.

``Writer`` packs WARC/1.1 records into one stored member of a ZIP file, with a
stored index of record offsets beside it. ``Package`` opens such a file through a
function that fetches byte ranges: it parses the end record, the ZIP64 locator
and record, and the central directory, finds stored members by name, and reads
single records or runs of them without unpacking anything.

Of records with equal payloads of at least ``REVISIT_BYTES`` the smallest page_id
is a response, the others are revisits that name it. A revisit carries the HTTP
headers with the length of the payload, and its digest, but no payload. Null
html is an empty payload; rows that repeat the smallest page_id of a payload are
responses too; a null page_id counts as the largest and never is referred to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches
from conefix.session import Scratch

REVISIT_BYTES = 100
#: Payload bytes after which a package is closed and the next begun.
PACKAGE_BYTES = 8 << 20
#: Revisits (an id, a digest and an id each) up to which their table may be broadcast.
BROADCAST_ROWS = 100_000
RECORDS = "archive/data.warc"
INDEX = "indexes/index.cdxj"
MANIFEST = "datapackage.json"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Signatures and limits of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class ArchiveError(ValueError):
    """The bytes are no ZIP package, or one that this reader cannot read by ranges."""


# --- records ---------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value without line breaks, which are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: memoryview

    @staticmethod
    def parse(data: memoryview) -> tuple[Record, int]:
        """The record at the start of ``data`` and its length in bytes."""
        raw = bytes(data[: min(len(data), 1 << 16)])
        end = raw.find(b"\r\n\r\n")
        if end < 0:
            raw = bytes(data)
            end = raw.find(b"\r\n\r\n")
        if end < 0 or not raw.startswith(b"WARC/"):
            raise ArchiveError("no WARC record")
        headers = _headers(raw[:end])
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ArchiveError("the record breaks off")
        http_end = bytes(block[: 1 << 16]).find(b"\r\n\r\n")
        http = _headers(bytes(block[:http_end])) if http_end >= 0 else {}
        return Record(headers, http, block[http_end + 4 :] if http_end >= 0 else block), end + 4 + size + 4


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(text) if text else None


# --- packages --------------------------------------------------------------


class Writer:
    """Collects records and closes them into a ZIP package of stored members."""

    def __init__(self, zip64: bool = False):
        self.zip64 = zip64
        self.records: list[bytes] = []
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        data = record(page_id, url, payload, digest, refers_to)
        entry = {"url": url or "", "page": page_id, "offset": self.size, "length": len(data), "digest": digest, "type": "response" if refers_to is None else "revisit"}
        self.index.append(f"{_clean(url or '').replace(' ', '%20')} {DATE} {json.dumps(entry)}")
        self.records.append(data)
        self.size += len(data)

    def close(self) -> bytes:
        index = "".join(f"{line}\n" for line in sorted(self.index)).encode()
        members = {RECORDS: b"".join(self.records), INDEX: index}
        manifest = {"profile": "data-package", "resources": [{"path": n, "bytes": len(d), "hash": f"sha256:{hashlib.sha256(d).hexdigest()}"} for n, d in members.items()]}
        members[MANIFEST] = json.dumps(manifest).encode()
        return zip_stored(members, self.zip64)


def zip_stored(members: dict[str, bytes], zip64: bool = False) -> bytes:
    """A ZIP file of uncompressed members; with ZIP64 records where sizes need them, or on request."""
    parts, central, at = [], [], 0
    for name, data in members.items():
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= MAX32 or at >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = MAX32 if wide else size
        parts += [LOCAL, struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)), raw, extra, data]
        more = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(more), 0, 0, 0, 0, MAX32 if wide else at) + raw + more)
        at += 30 + len(raw) + len(extra) + size
    directory = b"".join(central)
    tail = b""
    if zip64 or at >= MAX32 or len(central) >= MAX16:
        tail = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(central), len(central), len(directory), at) + LOCATOR64 + struct.pack("<IQI", 0, at + len(directory), 1)
        tail += END + struct.pack("<HHHHIIH", 0, 0, MAX16, MAX16, MAX32, MAX32, 0)
    else:
        tail = END + struct.pack("<HHHHIIH", 0, 0, len(central), len(central), len(directory), at, 0)
    return b"".join([*parts, directory, tail])


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int


class Package:
    """A ZIP file behind ``fetch(offset, length)``; only the ranges that are asked for are read."""

    def __init__(self, fetch: Callable[[int, int], bytes | memoryview], size: int):
        self.fetch, self.size = fetch, size
        tail_at = max(0, size - (1 << 16) - 22)
        tail = bytes(fetch(tail_at, size - tail_at))
        at = tail.rfind(END)
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ArchiveError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if MAX16 == count or MAX32 in (length, start):
            place = tail_at + at - 20
            if place < 0 or bytes(fetch(place, 4)) != LOCATOR64:
                raise ArchiveError("no ZIP64 locator")
            end64 = bytes(fetch(struct.unpack("<Q", fetch(place + 8, 8))[0], 56))
            if end64[:4] != END64:
                raise ArchiveError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members = self._directory(bytes(fetch(start, length)), count)

    @classmethod
    def of_bytes(cls, data: bytes) -> Package:
        view = memoryview(data)
        return cls(lambda offset, length: view[offset : offset + length], len(data))

    @classmethod
    def of_file(cls, path: str) -> Package:
        """A file of any size on a disk or mount that the reader sees; each range is one read."""
        file = open(path, "rb")

        def fetch(offset: int, length: int) -> bytes:
            file.seek(offset)
            return file.read(length)

        return cls(fetch, os.path.getsize(path))

    @staticmethod
    def _directory(raw: bytes, count: int) -> dict[str, Member]:
        found, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ArchiveError("the central directory breaks off")
            method, _, _, crc, packed, size, n, extra, note = struct.unpack_from("<HHHIIIHHH", raw, at + 10)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n].decode("utf-8", "replace")
            place, stop = at + 46 + n, at + 46 + n + extra
            while place + 4 <= stop:
                kind, k = struct.unpack_from("<HH", raw, place)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{k // 8}Q", raw, place + 4))
                    size = next(wide) if size == MAX32 else size
                    packed = next(wide) if packed == MAX32 else packed
                    header = next(wide) if header == MAX32 else header
                place += 4 + k
            if method == 0 and packed != size:
                raise ArchiveError(f"{name}: a stored member of two sizes")
            found[name] = Member(name, method, crc, size, header)
            at = stop + note
        return found

    def start_of(self, member: Member) -> int:
        """Where the data of a stored member begin."""
        if member.method:
            raise ArchiveError(f"{member.name} is compressed; records cannot be read by ranges")
        head = bytes(self.fetch(member.header, 30))
        if head[:4] != LOCAL:
            raise ArchiveError(f"{member.name}: no local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + extra

    def read(self, name: str) -> memoryview:
        member = self.members[name]
        return memoryview(self.fetch(self.start_of(member), member.size))

    def entries(self, name: str = INDEX) -> Iterator[dict]:
        """The lines of an index, as dictionaries."""
        for line in bytes(self.read(name)).decode().splitlines():
            if "{" in line:
                yield json.loads(line[line.index(" {") + 1 :])

    def records(self, name: str = RECORDS, index: str = INDEX) -> Iterator[Record]:
        """All records of a stored member, each read by its range in the index."""
        zero = self.start_of(self.members[name])
        for entry in sorted(self.entries(index), key=lambda e: e["offset"]):
            yield Record.parse(memoryview(self.fetch(zero + entry["offset"], entry["length"])))[0]


# --- tables ----------------------------------------------------------------


def first_pages(narrow: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages that revisit another one.

    ``narrow`` has page_id, digest and n, the payload's bytes. Partial aggregates keep a
    payload with many copies to a row per task.
    """
    known = narrow.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "page_id").count()
    least = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(least, "digest").where("page_id IS NULL OR page_id != refers_to").select("page_id", "digest", "refers_to")


def _packer(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, writer = TaskContext.get().partitionId(), 0, Writer()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([len(writer.records)], pa.int64()), pa.array([writer.close()], pa.binary())], ["package", "n_records", "content"])

        for whole in batches:
            for batch in slices(whole, "payload"):
                for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    writer.add(page, url, payload, digest, refers)
                    if writer.size >= limit:
                        yield close()
                        n, writer = n + 1, Writer()
        if writer.records:
            yield close()

    return run


def write_packages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", limit: int = PACKAGE_BYTES) -> DataFrame:
    """``(package, n_records, content)``: every page as a record of some ZIP package.

    Revisits are found on ids and digests alone. Payloads meet them in place while there are
    at most ``BROADCAST_ROWS`` of them, and are shuffled only beyond.
    """
    small_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "wacz")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    digested = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = scratch.save(digested.select("page_id", "digest", F.octet_length("payload").alias("n")), "digests")
    revisits = scratch.save(first_pages(narrow).withColumnsRenamed({"page_id": "r_page", "digest": "r_digest"}), "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    joined = digested.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_page", "r_digest")
    return joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_packer(limit), "package string, n_records long, content binary")


RECORD_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_rows(package: Package) -> pa.RecordBatch:
    rows = []
    for r in package.records():
        digest, kind = r.headers["warc-payload-digest"].removeprefix("sha256:"), r.headers["warc-type"]
        size, refers = int(r.http["content-length"]), page_of(r.headers.get("warc-refers-to"))
        if kind == "response":
            size, found = len(r.payload), hashlib.sha256(r.payload).hexdigest()
            if found != _hex(digest):
                raise ArchiveError(f"the payload of {r.headers['warc-record-id']} has another digest")
        rows.append((page_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), size, _hex(digest), kind, refers))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_packages(packages: DataFrame, column: str = "content") -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` of every record.

    ``packages`` may be the table of ``write_packages`` or files that
    ``spark.read.format("binaryFile")`` found. Payloads of responses are digested again and
    must have the digest of their record. Null contents have no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                content = whole.column(0)[i].as_py()
                if content is not None:
                    yield _record_rows(Package.of_bytes(content))

    return packages.select(F.col(column)).mapInArrow(run, RECORD_ROWS)


def read_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """The same rows of package files of any size, named by paths that the workers see (a shared mount); only ranges are read. Null paths have no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for path in whole.column(0).to_pylist():
                if path is not None:
                    yield _record_rows(Package.of_file(path.removeprefix("file://")))

    return paths.select(F.col(column).cast("string")).mapInArrow(run, RECORD_ROWS)


def _hex(digest: str) -> str:
    """A digest of either usual spelling, hexadecimal or base32, as lower-case hexadecimal."""
    return digest.lower() if len(digest) == 64 else base64.b32decode(digest.upper() + "=" * (-len(digest) % 8)).hex()


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to packages in the shared folder, then read every record back."""
    scratch = Scratch(pages.sparkSession, "wacz")
    return read_packages(scratch.save(write_packages(pages), "packages"))
