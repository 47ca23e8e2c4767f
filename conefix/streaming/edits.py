"""A stream of source edits, answered after every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from conefix.plans.incremental import Analysis

EDITS = "seq long, program string, path string, text string"


def latest(edits: DataFrame) -> DataFrame:
    """Of several edits of a file in one batch, the last."""
    order = Window.partitionBy("program", "path").orderBy(F.desc("seq"))
    return edits.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "seq")


def kept_batches(analysis: Analysis, state: str) -> list[int]:
    """Numbers of the batches whose facts were written whole, in order."""
    context = analysis.spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(state)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [x.getPath() for x in files.listStatus(root)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def follow(edits: DataFrame, analysis: Analysis, answer: Callable[[DataFrame, int], None], demand: DataFrame | None = None, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Apply a stream of ``EDITS`` to an analysis; ``answer(cells, batch)`` gets what the demand asks for after each batch.

    With a ``checkpoint`` the facts after each batch are kept in a folder beside it, so a new
    driver goes on from the last batch that was applied, not from the first sources. A batch
    that is delivered again starts from the facts before it.
    """
    state = f"{checkpoint}-facts" if checkpoint else None
    kept, first = kept_batches(analysis, state) if state else [], analysis.facts
    if kept:
        analysis.restore(f"{state}/{kept[-1]}")

    def batch(rows: DataFrame, number: int) -> None:
        if state and number in kept:
            if number - 1 in kept:
                analysis.restore(f"{state}/{number - 1}")
            else:
                analysis.take(first)
            kept.remove(number)
        analysis.edit(latest(rows))
        if state:
            analysis.keep(f"{state}/{number}")
        answer(analysis.query(demand), number)

    writer = edits.writeStream.foreachBatch(batch).trigger(**(trigger or {"availableNow": True}))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
