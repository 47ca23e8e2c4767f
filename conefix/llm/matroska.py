"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores a byte payload as 8-bit PCM samples (mono, 8 kHz) in a Matroska
file: frames of up to 512 samples, laced into blocks of up to eight, clusters of
about four seconds, one cue for each cluster. ``Reader`` parses any Matroska or
WebM file by elements: variable-length ids and sizes, sizes left open, Void and
CRC elements, SimpleBlocks and BlockGroups with all four lacings, and cues. It
yields packets with track, timestamp and byte range, never the data itself.

Null texts are empty and stored as 64 zero bytes. Equal texts give equal files:
there are no dates and no random ids in them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches, values
from conefix.session import Scratch

RATE = 8000
FRAME = 512
LACED = 8
CLUSTER_FRAMES = 64
ALIGN = 64

#: Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
VOID, CRC32 = 0xEC, 0xBF
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that may end a cluster or segment of unknown size.
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS}
LACINGS = ("none", "xiph", "fixed", "ebml")


class MediaError(ValueError):
    """The bytes are no Matroska file, or one that breaks off."""


def vint(value: int, length: int = 0) -> bytes:
    """A size as an EBML variable-length integer, of ``length`` bytes if given."""
    n = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and the body of a block: none for one frame, fixed for equal sizes, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    head = [bytes([len(frames) - 1]), vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
        head.append(vint(b - a + (1 << 7 * n - 1) - 1, n))
    return 0x06, b"".join(head) + b"".join(frames)


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_AUDIO = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
_TRACK = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + _AUDIO))


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(ALIGN - len(text) % ALIGN if len(text) % ALIGN or not text else 0)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose samples are the bytes of ``payload``."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(payload) / RATE)) + element(MUXING_APP, b"conefix") + element(WRITING_APP, b"conefix"))
    parts, at, cues = [info, _TRACK], len(info) + len(_TRACK), []
    for i in range(0, len(frames), CLUSTER_FRAMES):
        zero = 1000 * i * FRAME // RATE
        body = [uint(TIMESTAMP, zero)]
        for k in range(i, min(i + CLUSTER_FRAMES, len(frames)), LACED):
            flags, data = lace(frames[k : min(k + LACED, i + CLUSTER_FRAMES)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 1000 * k * FRAME // RATE - zero, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, zero) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    cluster: int
    lacing: str
    keyframe: bool
    offset: int
    size: int


@dataclass
class Reader:
    """A parsed file: tracks by number, packets in file order, cues with absolute cluster offsets."""

    data: bytes
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0

    def __post_init__(self):
        ident, start, end = self._element(0, len(self.data))
        if ident != EBML:
            raise MediaError("no EBML header")
        at = end
        while at < len(self.data):
            ident, start, end = self._element(at, len(self.data))
            if ident == SEGMENT:
                self._segment(start, end)
            at = end

    def _vint(self, at: int, keep: bool) -> tuple[int, int]:
        """A variable-length integer and where it ends; -1 for an unknown size. keep: with its marker, as ids have it."""
        if at >= len(self.data):
            raise MediaError(f"the file breaks off at {at}")
        first = self.data[at]
        n = 9 - first.bit_length()
        if n > 8 or at + n > len(self.data):
            raise MediaError(f"no integer at {at}")
        value = int.from_bytes(self.data[at : at + n], "big")
        if keep:
            return value, at + n
        value &= (1 << 7 * n) - 1
        return (-1 if value == (1 << 7 * n) - 1 else value), at + n

    def _element(self, at: int, limit: int) -> tuple[int, int, int]:
        """Id, first byte and end of the body. Only a segment and a cluster may leave their size open: they end before the next element of their level."""
        ident, at = self._vint(at, True)
        size, at = self._vint(at, False)
        if size >= 0:
            if at + size > len(self.data):
                raise MediaError(f"the element at {at} breaks off")
            return ident, at, at + size
        if ident not in (SEGMENT, CLUSTER):
            raise MediaError(f"the element at {at} leaves its size open")
        return ident, at, self._open_end(at, limit, {SEGMENT, EBML} if ident == SEGMENT else {SEGMENT, EBML, *_TOP})

    def _open_end(self, at: int, limit: int, stops: set[int]) -> int:
        """Where a body of unknown size ends: before the first element of ``stops``. Inner clusters of unknown size are passed child by child."""
        while at < limit:
            inner, body = self._vint(at, True)
            if inner in stops:
                break
            size, body = self._vint(body, False)
            if size >= 0:
                at = body + size
            elif inner == CLUSTER:
                at = body
            else:
                raise MediaError(f"the element at {at} leaves its size open")
        if at > len(self.data):
            raise MediaError(f"the element before {at} breaks off")
        return at

    def _children(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        while start < end:
            ident, body, stop = self._element(start, end)
            if ident not in (VOID, CRC32):
                yield ident, body, stop
            start = stop

    def _uint(self, a: int, b: int) -> int:
        return int.from_bytes(self.data[a:b], "big")

    def _float(self, a: int, b: int) -> float:
        return struct.unpack(">d" if b - a == 8 else ">f", self.data[a:b])[0] if b > a else 0.0

    def _segment(self, start: int, end: int) -> None:
        for ident, a, b in self._children(start, end):
            if ident == INFO:
                for x, c, d in self._children(a, b):
                    if x == TIMESTAMP_SCALE:
                        self.scale = self._uint(c, d)
                    elif x == DURATION:
                        self.duration = self._float(c, d)
            elif ident == TRACKS:
                for x, c, d in self._children(a, b):
                    if x == TRACK_ENTRY:
                        self._track(c, d)
            elif ident == CLUSTER:
                self._cluster(a, b)
            elif ident == CUES:
                for x, c, d in self._children(a, b):
                    if x == CUE_POINT:
                        self._cue(c, d, start)

    def _track(self, a: int, b: int) -> None:
        found = {"default_ns": 0, "rate": 0.0, "channels": 1, "bits": 0, "codec": ""}
        for x, c, d in self._children(a, b):
            if x == TRACK_NUMBER:
                self.tracks[self._uint(c, d)] = found
            elif x == TRACK_TYPE:
                found["type"] = self._uint(c, d)
            elif x == CODEC_ID:
                found["codec"] = bytes(self.data[c:d]).decode("ascii", "replace")
            elif x == DEFAULT_DURATION:
                found["default_ns"] = self._uint(c, d)
            elif x == AUDIO:
                for y, e, f in self._children(c, d):
                    if y == SAMPLING:
                        found["rate"] = self._float(e, f)
                    elif y == CHANNELS:
                        found["channels"] = self._uint(e, f)
                    elif y == BIT_DEPTH:
                        found["bits"] = self._uint(e, f)

    def _cue(self, a: int, b: int, zero: int) -> None:
        time, places = 0, []
        for x, c, d in self._children(a, b):
            if x == CUE_TIME:
                time = self._uint(c, d)
            elif x == CUE_TRACK_POSITIONS:
                inner = {y: self._uint(e, f) for y, e, f in self._children(c, d) if y in (CUE_TRACK, CUE_CLUSTER_POSITION)}
                places.append((inner.get(CUE_TRACK, 0), zero + inner.get(CUE_CLUSTER_POSITION, 0)))
        self.cues += [(time * self.scale, track, at) for track, at in places]

    def _cluster(self, a: int, b: int) -> None:
        self.clusters.append(a)
        number, zero = len(self.clusters) - 1, 0
        for x, c, d in self._children(a, b):
            if x == TIMESTAMP:
                zero = self._uint(c, d)
            elif x == SIMPLE_BLOCK:
                self._block(c, d, zero, number, None)
            elif x == BLOCK_GROUP:
                inner = [(y, e, f) for y, e, f in self._children(c, d)]
                for y, e, f in inner:
                    if y == BLOCK:
                        self._block(e, f, zero, number, all(z != REFERENCE for z, _, _ in inner))

    def _block(self, a: int, b: int, zero: int, cluster: int, key: bool | None) -> None:
        track, at = self._vint(a, False)
        if at + 3 > b:
            raise MediaError(f"the block at {a} breaks off")
        shift, flags = struct.unpack_from(">hB", self.data, at)
        at += 3
        lacing = flags >> 1 & 3
        if lacing:
            n = self.data[at] + 1
            at += 1
            if lacing == 2:
                if (b - at) % n:
                    raise MediaError(f"the laces at {at} are not equal")
                sizes = [(b - at) // n] * n
            else:
                sizes = []
                for i in range(n - 1):
                    size = 0
                    if lacing == 1:
                        while self.data[at] == 255:
                            size, at = size + 255, at + 1
                        size, at = size + self.data[at], at + 1
                    else:
                        size, stop = self._vint(at, False)
                        if i:
                            size = sizes[-1] + size - ((1 << 7 * (stop - at) - 1) - 1)
                        at = stop
                    sizes.append(size)
                sizes.append(b - at - sum(sizes))
        else:
            sizes = [b - at]
        if min(sizes) < 0:
            raise MediaError(f"the laces at {at} are longer than their block")
        known = self.tracks.get(track, {})
        time, keyframe = (zero + shift) * self.scale, bool(flags & 0x80) if key is None else key
        for size in sizes:
            self.packets.append(Packet(track, time, cluster, LACINGS[lacing], keyframe, at, size))
            at += size
            if known.get("default_ns"):
                time += known["default_ns"]
            elif known.get("rate") and known.get("bits") and known.get("channels"):
                time += round(1e9 * size * 8 / (known["bits"] * known["channels"] * known["rate"]))

    def samples(self, track: int = 1) -> bytes:
        """The track's stored bytes, by the packets' ranges."""
        return b"".join(self.data[p.offset : p.offset + p.size] for p in self.packets if p.track == track)


def feature(reader: Reader, payload: bytes) -> str:
    """Whole-number features of the container and of its samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    last = reader.packets[-1]
    turns = int((np.diff((x >= 128).astype(np.int8)) != 0).sum())
    laces = sum(p.lacing != "none" for p in reader.packets)
    return f"packets={len(reader.packets)};clusters={len(reader.clusters)};cues={len(reader.cues)};laced={laces};last_ms={last.timestamp_ns // 1_000_000};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(x.max())};turns={turns};step={int(np.abs(np.diff(x)).sum())}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw = values(batch, "text")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array([mux(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each packet: track, timestamp, cluster, lacing, keyframe, byte range. Null media have none; a file that breaks the format has one row with its error."""
    names = ["track", "timestamp_ns", "cluster", "lacing", "keyframe", "offset", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                keys, rows = batch.column("key").to_pylist(), []
                for k, data in zip(keys, batch.column("media").to_pylist(), strict=True):
                    try:
                        found = [tuple(getattr(p, n) for n in names) for p in (Reader(data).packets if data is not None else ())]
                        if any(isinstance(v, int) and v.bit_length() > 63 for row in found for v in row):
                            raise MediaError("a track or timestamp beyond 63 bits")
                        rows += [(k, *row, None) for row in found]
                    except (MediaError, IndexError, ArithmeticError, ValueError, struct.error) as error:
                        rows.append((k, *[None] * len(names), str(error)))
                columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 2)
                kinds = [batch.column("key").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", *names, "error"])

    rows = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, track long, timestamp_ns long, cluster long, lacing string, keyframe boolean, offset long, size long, error string").withColumnRenamed("key", key)


def read_back(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of stored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                rows = []
                for data in batch.column("media").to_pylist():
                    reader = Reader(data)
                    payload = reader.samples()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(reader, payload)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store all texts as a table of media files, then read that table back."""
    scratch = Scratch(docs.sparkSession, "matroska")
    return read_back(scratch.save(store(docs, key, text), "media"))
