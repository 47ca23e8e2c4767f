"""A registry of dependencies as keyed state of a stream.

The state of a callee is the set of those that have used one of its summaries, by
context. Rows of a stream add a caller, pop what depends on a callee (all of it, or one context),
or drop callers that are stale. Micro-batches see each callee's rows in their order; the state survives
them and restarts with the checkpoint.

Rows: ``(callee, seq, op, ctx, caller)``; ``op`` is add, pop (ctx null: all contexts) or stale. A pop gives a row
for each caller and context that it takes, ``(callee, seq, ctx, caller, self_loop)``; a callee that depends
on itself in the same context is marked, as it is not to be dirtied again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "ctx array<string>, caller array<string>"


def changed(held: set[tuple[str, str]], rows: Iterator[tuple]) -> tuple[set[tuple[str, str]], list[tuple]]:
    """The registry of one callee after some rows (seq, op, ctx, caller) in order, and what its pops have taken."""
    taken = []
    for seq, op, ctx, caller in rows:
        if op == "add":
            held.add((ctx, caller))
        elif op == "stale":
            held = {d for d in held if d[1] != caller}
        elif op == "pop":
            gone = {d for d in held if ctx is None or d[0] == ctx}
            taken += [(seq, *d) for d in sorted(gone)]
            held -= gone
    return held, taken


def taken(rows: DataFrame) -> DataFrame:
    """What the pops of a stream (or of a table) of rows take from the registry."""
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("callee", "seq")}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("seq")
        held = set(zip(*state.get, strict=True)) if state.exists else set()
        listed = frame[["seq", "op", "ctx", "caller"]].astype(object).where(frame[["seq", "op", "ctx", "caller"]].notna(), None)
        held, gone = changed(held, listed.itertuples(index=False, name=None))
        if held:
            order = sorted(held)
            state.update(([c for c, _ in order], [c for _, c in order]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], seq, ctx, caller, str(key[0]) == caller) for seq, ctx, caller in gone], columns=["callee", "seq", "ctx", "caller", "self_loop"])

    out = f"callee {kinds['callee']}, seq {kinds['seq']}, ctx string, caller string, self_loop boolean"
    return rows.select("callee", "seq", "op", "ctx", "caller").groupBy("callee").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)


def follow(source: DataFrame, target: str, checkpoint: str) -> None:
    """Work off what has arrived at a streaming ``source`` of rows, and add what is taken to the table at ``target``."""
    query = taken(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
