"""Helpers for Arrow functions: column access, slices balanced by bytes, and memory that goes back."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

#: Bytes of text that one slice of a batch holds at most, unless one row alone is larger.
SLICE_BYTES = 1 << 20
#: Rows of text in one Arrow batch; the usual 10,000 would hold hundreds of MB of long texts at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to ``BATCH_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back: workers live on, and the next stage's need would come on top of it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass


def slices(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` (binary) holds about ``limit`` bytes (``SLICE_BYTES``)."""
    limit = limit or SLICE_BYTES
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = total = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
        total += n
    if start < len(sizes):
        yield batch.slice(start)
    if total > limit:
        release()


def values(batch: pa.RecordBatch, column: str, null: bytes = b"") -> list[bytes]:
    """A binary column as bytes, nulls as ``null``."""
    return [null if v is None else v for v in batch.column(column).to_pylist()]
