"""Matroska and ZIP/WARC: exact round trips, odd files, and tables."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from conefix.llm import matroska as M
from conefix.llm import wacz


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 512, 4096, 5000, 40_000, 300_000])
def test_mux_round_trip(size):
    text = random.Random(size).randbytes(size)
    payload = M.padded(text)
    assert len(payload) % 64 == 0 and payload.startswith(text) and 0 < len(payload) <= max(64, size + 63)
    data = M.mux(payload)
    reader = M.Reader(data)
    assert reader.samples() == payload and M.mux(payload) == data
    assert reader.tracks[1]["codec"] == "A_PCM/INT/LIT" and reader.tracks[1]["rate"] == M.RATE
    assert [t for t, _, _ in reader.cues] == sorted({p.timestamp_ns for p in reader.packets if p.timestamp_ns % (1000 * M.CLUSTER_FRAMES * M.FRAME // M.RATE * 1_000_000) == 0})
    assert all(data[at : at + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, at in reader.cues)
    assert [p.timestamp_ns for p in reader.packets] == [1_000_000 * 1000 * i * M.FRAME // M.RATE for i in range(len(reader.packets))]


def block(track: int, shift: int, flags: int, body: bytes) -> bytes:
    return M.vint(track) + struct.pack(">hB", shift, flags) + body


def test_all_lacings_groups_and_open_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d"]
    xiph = bytes([3, 255, 45, 5, 255, 255, 190]) + b"".join(frames)
    fixed = bytes([1]) + b"xxyy"
    flags, ebml = M.lace(frames)
    assert flags == 6
    body = M.uint(M.TIMESTAMP, 10) + M.element(M.SIMPLE_BLOCK, block(1, 0, 0x82, xiph)) + M.element(M.VOID, b"123") + M.element(M.SIMPLE_BLOCK, block(200, -3, 0x04, fixed))
    body += M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block(1, 7, flags, ebml)) + M.uint(M.BLOCK_DURATION, 3)) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block(1, 8, 0, b"z")) + M.uint(M.REFERENCE, 1))
    open_cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + body
    second = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 99) + M.element(M.SIMPLE_BLOCK, block(1, 0, 0x80, b"end")))
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M._TRACK + open_cluster + second
    reader = M.Reader(data)
    found = [(p.track, p.timestamp_ns // 1_000_000, p.lacing, p.keyframe, bytes(data[p.offset : p.offset + p.size])) for p in reader.packets]
    assert [f[4] for f in found] == [*frames, b"xx", b"yy", *frames, b"z", b"end"]
    assert [f[2] for f in found] == ["xiph"] * 4 + ["fixed"] * 2 + ["ebml"] * 4 + ["none"] * 2
    assert [f[0] for f in found] == [1] * 4 + [200] * 2 + [1] * 6 and [f[1] for f in found][4] == 7
    assert [f[3] for f in found] == [True] * 4 + [False] * 2 + [True] * 4 + [False, True] and len(reader.clusters) == 2


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**55])
def test_integers(value):
    raw = M.vint(value)
    reader = M.Reader.__new__(M.Reader)
    reader.data = raw
    assert reader._vint(0, False) == (value, len(raw))


def test_media_tables(spark):
    rows = [(1, "héllo " * 300), (2, None), (3, ""), (4, "héllo " * 300), (5, "x" * 64), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.store_and_read(docs).collect()}
    for doc, text in rows:
        payload = M.padded((text or "").encode())
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(M.mux(payload)).hexdigest() and r["media_bytes"] == len(M.mux(payload))
    assert got[1][2:] == got[4][2:] and got[2][2:] == got[3][2:]
    media = M.store(docs).union(spark.createDataFrame([(9, 0, b"broken"), (10, 0, None)], "doc_id long, n_bytes long, media binary"))
    table = M.packets(media).collect()
    assert [r["error"] is not None for r in table if r["doc_id"] == 9] == [True] and not [r for r in table if r["doc_id"] == 10]
    assert sum(r["size"] for r in table if r["doc_id"] == 1) == len(M.padded(rows[0][1].encode()))
    assert M.store_and_read(docs.limit(0)).count() == 0


def test_broken_media_have_a_row_with_their_error(spark):
    open_void = M.CUES.to_bytes(4, "big") + b"\xff"
    nested = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\xff" + open_void * 3000
    silent = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.uint(M.TRACK_NUMBER, 1) + M.element(M.AUDIO, M.element(M.SAMPLING, struct.pack(">d", 8000.0)) + M.uint(M.CHANNELS, 0) + M.uint(M.BIT_DEPTH, 8))))
    cluster = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 1) + M.element(M.SIMPLE_BLOCK, block(1, 0, 0x84, b"\x01abcd")))
    late = M.element(M.CLUSTER, M.uint(M.TIMESTAMP, 2**63) + M.element(M.SIMPLE_BLOCK, block(1, 0, 0x80, b"x")))
    whole = M.mux(M.padded(b"abc" * 500))
    files = {1: nested, 2: M._HEAD + M.element(M.SEGMENT, silent + cluster), 3: M._HEAD + M.element(M.SEGMENT, M._TRACK + late), 4: b"", **{10 + k: whole[: len(whole) * k // 20] for k in range(1, 20)}}
    rng = random.Random(5)
    for k in range(40, 80):
        noisy = bytearray(whole)
        for _ in range(5):
            noisy[rng.randrange(len(noisy))] = rng.randrange(256)
        files[k] = bytes(noisy)
    table = M.packets(spark.createDataFrame(list(files.items()), "doc_id long, media binary")).collect()
    errors = {r["doc_id"] for r in table if r["error"] is not None}
    assert {1, 3, 4} <= errors and 2 not in errors and [r["size"] for r in table if r["doc_id"] == 2] == [2, 2]


def test_features_by_their_own_words(spark):
    """Features against figures that come from the payload alone."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("aé~ z", k=n))) for i, n in enumerate([0, 1, 70, 4000, 40_000])]
    got = {r["doc_id"]: dict(x.split("=") for x in r["feature"].split(";")) for r in M.store_and_read(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        data = text.encode()
        data += bytes(-len(data) % 64 if data else 64)
        frames = -(-len(data) // 512)
        want = {"sum": sum(data), "energy": sum(b * b for b in data), "peak": max(data), "turns": sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:])), "step": sum(abs(a - b) for a, b in zip(data, data[1:])), "packets": frames, "clusters": -(-frames // 64), "cues": -(-frames // 64), "last_ms": (frames - 1) * 512 // 8}
        assert {k: int(got[i][k]) for k in want} == want


PAGES = [(5, "http://a/\r\nX: 1", "é" * 100), (3, "http://b", "é" * 100), (9, None, "é" * 100), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (10, "u", "<p>\r\n\r\nWARC/1.1\r\n</p>" * 9), (3, "http://b", "é" * 100), (None, "u", "é" * 100), (11, "u", "x" * 99), (12, "u", "x" * 99)]


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files_and_read_by_ranges(zip64):
    writer = wacz.Writer(zip64)
    for page, url, html in PAGES:
        payload = (html or "").encode()
        writer.add(page, url, payload, hashlib.sha256(payload).hexdigest(), None)
    data = writer.close()
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        assert file.testzip() is None and file.namelist() == [wacz.RECORDS, wacz.INDEX, wacz.MANIFEST]
        body = file.read(wacz.RECORDS)
    read = []

    def fetch(offset, length):
        read.append(length)
        return data[offset : offset + length]

    package = wacz.Package(fetch, len(data))
    assert bytes(package.read(wacz.RECORDS)) == body and package.members[wacz.RECORDS].crc == zlib.crc32(body)
    assert [bytes(r.payload) for r in package.records()] == [(h or "").encode() for _, _, h in PAGES]
    entry = next(e for e in package.entries() if e["page"] == 10)
    read.clear()
    zero = package.start_of(package.members[wacz.RECORDS])
    record, size = wacz.Record.parse(memoryview(package.fetch(zero + entry["offset"], entry["length"])))
    assert bytes(record.payload) == PAGES[7][2].encode() and size == entry["length"] and sum(read) == entry["length"] + 30


def test_packages_with_comments_and_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("a", b"x" * 50)
        file.writestr("b", b"y" * 50, zipfile.ZIP_DEFLATED)
        file.comment = b"note PK\x05\x06"
    package = wacz.Package.of_bytes(out.getvalue())
    assert bytes(package.read("a")) == b"x" * 50
    with pytest.raises(wacz.ArchiveError):
        package.read("b")
    with pytest.raises(wacz.ArchiveError):
        wacz.Package.of_bytes(b"no archive")


@pytest.mark.parametrize("bound", [100_000, 0])
def test_archive_table(spark, monkeypatch, bound, tmp_path):
    monkeypatch.setattr(wacz, "PACKAGE_BYTES", 700)
    monkeypatch.setattr(wacz, "BROADCAST_ROWS", bound)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    got = sorted((tuple(r) for r in wacz.archive_and_read(pages).drop("url").collect()), key=str)
    first: dict[bytes, int] = {}
    for page, _, html in PAGES:
        if page is not None:
            first[(html or "").encode()] = min(page, first.get((html or "").encode(), page))
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        again = len(raw) >= 100 and page != first[raw]
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    assert got == sorted(want, key=str)
    assert wacz.archive_and_read(pages.limit(0)).count() == 0
    paths = []
    for r in wacz.write_packages(pages).collect():
        paths.append(str(tmp_path / f"{r['package']}.wacz"))
        with open(paths[-1], "wb") as file:
            file.write(r["content"])
    read = wacz.read_files(spark.createDataFrame([(p,) for p in [*paths, None]], "path string")).drop("url")
    assert sorted((tuple(r) for r in read.collect()), key=str) == got
