"""Packing: concatenate all documents and cut fixed windows.

The first pass encodes each text once and writes its ids with its place in its
partition. Prefix sums over the partitions' totals turn that place into a global
offset. The second pass cuts windows with native functions on the stored ids;
every piece carries its window, its place there and its place in its document, so a
document that crosses windows leaves a boundary record in each of them.

Only the last window is padded. Null texts are empty and hold the end id alone;
repeated rows are packed as often as they occur; an empty table gives no pieces. Ids
of documents keep their type, and null ones are packed like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches, values
from conefix.llm.tokens import byte_encoder
from conefix.session import Scratch

#: Partitions up to which the table of partition offsets (16 bytes a row) may be broadcast.
BROADCAST_PARTITIONS = 1_000_000


def encode_documents(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(part, base, doc_id, n, ids)``: ids as little-endian uint32, base the tokens before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, base = byte_encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = [np.array([*encode(t.decode()), end_id], dtype="<u4") for t in values(batch, "text")]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                bases = base + np.cumsum(n) - n
                base += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(bases), batch.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "base", "doc_id", "n", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"part long, base long, doc_id {kind}, n long, ids binary")


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of windows, one row each.

    doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (in the window), starts_doc, ends_doc, and the
    ids themselves (little-endian uint32) on request.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    held = scratch.save(encode_documents(docs, path, end_id, key, text), "ids")
    totals = scratch.save(held.groupBy("part").agg(F.max(F.col("base") + F.col("n")).alias("total")), "totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("zero"))
    if totals.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    at = F.col("at")
    placed = held.join(offsets, "part").withColumn("at", F.col("zero") + F.col("base"))

    def piece(w: F.Column) -> F.Column:
        start = F.greatest(w * window - at, F.lit(0))
        length = F.least((w + 1) * window - at, F.col("n")) - start
        ids = F.expr("ids").substr((start * 4 + 1).cast("int"), (length * 4).cast("int"))
        fields = [start.alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), w.alias("sequence_id"), F.pmod(at + start, F.lit(window)).cast("long").alias("offset")]
        return F.struct(*fields, *([ids.alias("ids")] if with_ids else []))

    first, last = F.floor(at / window).cast("long"), F.floor((at + F.col("n") - 1) / window).cast("long")
    cut = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    out = cut.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else []))
    return out.withColumns({"starts_doc": F.col("start") == 0, "ends_doc": F.col("start") + F.col("length") == F.col("doc_tokens")})


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` from pieces packed with ids; a window bounds each group."""
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
