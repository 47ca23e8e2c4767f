"""Exact deduplication of long texts by recipes of content-defined chunks.

A rolling hash over 32 bytes cuts every text where its content says so, so equal
stretches give equal chunks wherever they stand. The recipe of a text is the ordered list
of its chunks' fingerprints. Texts can be equal only where recipes recur, so only chunks
of those are moved: equal chunks are combined before the shuffle, each fingerprint is
checked to stand for one content, and contents that share one are numbered apart. What is
compared in the end are the ordered lists of verified identifiers, a few bytes for
each chunk; whole texts are never shuffled.

Defined cases: a null text is the empty text, which has no chunks and equals all other
empty texts. Null ids are below all others; of rows with the same id and text one stays.
Rows are told apart by a tag of their own, never by their id. An empty table gives an
empty result, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conefix.llm.arrow import release, slices, small_batches, values
from conefix.llm.skew import join_split
from conefix.session import Scratch

#: A chunk ends where so many leading bits of the rolling hash are zero: every 2048 bytes on average.
CUT_BITS = 11
#: Bytes of a chunk at least and at most; the last one of a text may be shorter.
LEAST, MOST = 512, 16384
#: Bytes of a fingerprint.
WIDTH = 16
#: Bytes the rolling hash looks back at, and that are hashed at once.
REACH, BLOCK = 32, 4 << 20
#: Bits of a filter: this many for each key, within these powers of two.
BITS_PER_KEY, FILTER_FROM, FILTER_TO = 16, 16, 26

_GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)


def marks(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last ``REACH`` bytes asks for a cut."""
    found = []
    for start in range(0, len(data), BLOCK):
        low = max(0, start - REACH + 1)
        h = _GEAR[data[low : start + BLOCK]]
        step = 1
        while step < REACH:  # sums over 2, 4, ... bytes, each byte shifted by its distance
            h[step:] += h[:-step].copy() << np.uint32(step)
            step *= 2
        found.append(np.flatnonzero(h[start - low :] >> np.uint32(32 - CUT_BITS) == 0) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def ends(places: list[int], size: int) -> list[int]:
    """Ends of the chunks of a text, from the places that ask for a cut."""
    out, last = [], 0
    for place in [*places, size]:
        while place - last > MOST:
            last += MOST
            out.append(last)
        if place - last >= LEAST and place < size:
            last = place
            out.append(last)
    if size > last:
        out.append(size)
    return out


def chunks_of(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text. Texts are hashed together; cuts are too far from a text's start to see the one before it."""
    data = b"".join(texts)
    places = marks(np.frombuffer(data, dtype=np.uint8))
    stops = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    out, start = [], 0
    for stop in stops.tolist():
        a, b = np.searchsorted(places, [start, stop], side="right")
        cut = ends([p - start for p in places[a:b].tolist()], stop - start)
        out.append([data[start + i : start + j] for i, j in zip([0, *cut[:-1]], cut, strict=True)] if cut else [])
        start = stop
    return out


def fingerprint(chunk: bytes, width: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:width]


def spot(key: bytes) -> int:
    """The place of a key in filters of any size: their leading bits."""
    return xxhash.xxh3_64_intdigest(key) >> 1


class Filter:
    """A set of keys as bits: it holds all of them and, by chance, some others. Its size has a bound, whatever the number of keys."""

    def __init__(self, spots: DataFrame, n: int):
        self.bits = min(FILTER_TO, max(FILTER_FROM, (n * BITS_PER_KEY).bit_length()))
        place = F.shiftright("spot", 63 - self.bits)
        words = spots.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("mask"))
        table = words.toArrow()
        self.words = np.zeros(1 << (self.bits - 5), dtype="<u4")
        self.words[table.column("word").to_numpy()] = table.column("mask").to_numpy().astype(np.uint32)

    def holds(self, at: int) -> bool:
        place = at >> (63 - self.bits)
        return bool(int(self.words[place >> 5]) >> (place & 31) & 1)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    return own.select("doc_id", F.monotonically_increasing_id().alias("tag"), F.sha2("text", 256).alias("sha"), "text")


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, doubted: Filter | None = None) -> DataFrame:
    """``(doc_id, tag, sha, n_bytes, n_chunks, recipe, spot, parts)``, a row for each document.

    ``recipe`` is the fingerprints of its chunks in order, ``tag`` a number of its own.
    ``parts(at, fp, chunk)`` holds the contents of chunks whose fingerprint is ``doubted``.
    """
    rows = _rows(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                cut = chunks_of(values(batch, "text"))
                prints = [[fingerprint(c, width) for c in row] for row in cut]
                lists = [b"".join(row) for row in prints]
                parts = [[{"at": i, "fp": f, "chunk": c} for i, (f, c) in enumerate(zip(fs, cs, strict=True)) if doubted is not None and doubted.holds(spot(f))] for fs, cs in zip(prints, cut, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("tag"), batch.column("sha"), pa.array([sum(map(len, c)) for c in cut], pa.int64()), pa.array([len(c) for c in cut], pa.int64()),
                        pa.array(lists, pa.binary()), pa.array([spot(r) for r in lists], pa.int64()), pa.array(parts, pa.list_(pa.struct([("at", pa.int64()), ("fp", pa.binary()), ("chunk", pa.binary())]))),
                    ],
                    ["doc_id", "tag", "sha", "n_bytes", "n_chunks", "recipe", "spot", "parts"],
                )
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, tag long, sha string, n_bytes long, n_chunks long, recipe binary, spot long, parts array<struct<at: bigint, fp: binary, chunk: binary>>")


def distinct_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, wanted: Filter | None = None) -> DataFrame:
    """``(fp, spot, chunk)``: the different chunks of all texts, or of those whose recipe is ``wanted``."""
    rows = _rows(docs, key, text).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = set()  # of one slice: copies that stand together are combined at once
                for row in chunks_of(values(batch, "text")):
                    prints = [fingerprint(c, width) for c in row]
                    if wanted is None or wanted.holds(spot(b"".join(prints))):
                        found.update(zip(prints, row, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.binary()), pa.array([spot(f) for f, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], ["fp", "spot", "chunk"])
        release()

    return rows.mapInArrow(run, "fp binary, spot long, chunk binary").distinct()


def chunk_store(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """All texts without repeated chunks: ``(doc_id, tag, at, chunk_id)`` and ``(chunk_id, chunk)``; ``restored`` puts them together again."""
    scratch = Scratch(docs.sparkSession, "chunk-store")
    numbered = scratch.save(distinct_chunks(docs, key, text, width).withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")) - 1), "chunks")
    clashing = numbered.where("n > 0")
    doubted = Filter(clashing.select("spot"), clashing.count())
    rows = scratch.save(recipes(docs, key, text, width, doubted), "recipes")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda i: F.struct(i.alias("at"), F.expr("recipe").substr((i * width + 1).cast("int"), F.lit(width)).alias("fp"))))
    listed = rows.where("n_chunks > 0").select("doc_id", "tag", at.alias("p")).select("doc_id", "tag", "p.at", "p.fp")
    exact = rows.select("tag", F.explode("parts").alias("p")).select("tag", "p.at", "p.fp", "p.chunk").join(numbered, ["fp", "chunk"]).select("tag", "at", "n")
    ids = listed.join(exact, ["tag", "at"], "left").select("doc_id", "tag", "at", F.struct("fp", F.coalesce("n", F.lit(0)).alias("n")).alias("chunk_id"))
    return ids, numbered.select(F.struct("fp", "n").alias("chunk_id"), "chunk")


def restored(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(doc_id, tag, text)`` of the texts of a store; empty ones have no chunks and no row."""
    parts = ids.join(chunks, "chunk_id").groupBy("tag", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "chunk"))).alias("parts"))
    return parts.select("doc_id", "tag", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.chunk))").cast("string").alias("text"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks``.

    Of equal texts the row with the greatest id stays.
    """
    scratch = Scratch(docs.sparkSession, "chunk-dedup")
    rows = scratch.save(recipes(docs, key, text, width), "recipes")
    again = scratch.save(rows.groupBy("recipe", "spot").agg(F.count("*").alias("n")).where("n > 1").select("spot"), "again")
    # Equal texts have equal recipes; verify that equal recipes mean equal texts, by the chunks of those that recur.
    chunks = distinct_chunks(docs, key, text, width, Filter(again, again.count()))
    clashing = scratch.save(chunks.select("fp", "spot").groupBy("fp", "spot").agg(F.count("*").alias("n")).where("n > 1"), "clashing")
    clashes = clashing.count()
    listed = rows.withColumn("others", F.lit(""))
    if clashes:
        listed = _told_apart(docs, key, text, width, chunks, clashing, clashes, scratch)
    own = listed.select("doc_id", "tag", "sha", "n_bytes", "n_chunks", F.struct("recipe", "others").alias("ids"))
    groups = own.groupBy("ids").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "tag")).alias("top")).withColumn("group_size", F.col("n"))
    joined = join_split(own, groups, "ids", rows.count(), rows="n")
    return joined.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("top.tag")).alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes", "n_chunks")


def _told_apart(docs: DataFrame, key: str, text: str, width: int, chunks: DataFrame, clashing: DataFrame, clashes: int, scratch: Scratch) -> DataFrame:
    """Recipes with ``others``: which of the contents that share a fingerprint stands where."""
    numbered = scratch.save(chunks.join(clashing.select("fp"), "fp", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy("chunk")) - 1), "numbered")
    rows = scratch.save(recipes(docs, key, text, width, Filter(clashing.select("spot"), clashes)), "doubted")
    parts = rows.select("tag", F.explode("parts").alias("p")).select("tag", "p.at", "p.fp", "p.chunk").join(numbered, ["fp", "chunk"])
    lists = parts.groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("l")).select("tag", F.to_json("l").alias("others"))
    return rows.drop("parts").join(lists, "tag", "left").withColumn("others", F.coalesce("others", F.lit("")))
