"""What the cells of an analysis say about a program's statements: array bounds and uses of null."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.plans import analysis, domains
from conefix.session import ship


def _accesses(e: object) -> Iterator[tuple[str, list]]:
    if isinstance(e, list) and e:
        if e[0] == "cell":
            yield e[1], e[2]
        for part in e[1:]:
            yield from _accesses(part)


def accesses_of(stmt: dict) -> list[tuple[str, list]]:
    """``(array, index)`` of every cell that a statement reads or writes."""
    own = [(stmt["arr"], stmt["index"])] if stmt["k"] == "store" else []
    return own + [a for e in (stmt.get("e"), stmt.get("index"), *stmt.get("args", ())) for a in _accesses(e)]


def in_bounds(state: object, arr: str, index: list) -> bool | None:
    """True if the index always fits, False if never, None if it may or may not."""
    box = state.sharp() if isinstance(state, domains.Both) else state
    if box is None:
        return None
    (lo, hi), (least, most) = analysis.evaluate(index, box), analysis.evaluate(["len", arr], box)
    if hi < 0 or lo >= most:
        return False
    below = hi < least
    if not below and isinstance(state, domains.Both):
        below = domains.at_most(state.oct, index, ["len", arr]) < 0
    return True if lo >= 0 and below else None


def _at_statements(edges: DataFrame, cells: DataFrame) -> DataFrame:
    at = cells.where("state IS NOT NULL").withColumnRenamed("loc", "src")
    return edges.select("program", "fn", "src", "dst", "stmt").join(at.select("program", "fn", "ctx", "src", "state"), ["program", "fn", "src"])


def bounds_checks(edges: DataFrame, cells: DataFrame, domain: str = "interval") -> DataFrame:
    """``(program, fn, ctx, loc, arr, index, safe)`` for each array access in each context; ``safe`` is null where it is open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = analysis.domain_named(domain).load
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for arr, index in accesses_of(json.loads(r.stmt)):
                    rows.append((r.program, r.fn, r.ctx, r.src, arr, json.dumps(index), in_bounds(load(r.state), arr, index)))
            yield pd.DataFrame(rows, columns=["program", "fn", "ctx", "loc", "arr", "index", "safe"]).astype({"safe": "boolean"})

    ship(edges.sparkSession)
    # A call and its exceptional twin hold the same accesses.
    return _at_statements(edges, cells).where("get_json_object(stmt, '$.k') <> 'xcall'").mapInPandas(run, "program string, fn string, ctx string, loc long, arr string, index string, safe boolean")


def null_uses(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``(program, fn, ctx, loc, variable, safe)`` for each variable used as an object, from cells of the nullness domain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                state = domains.null_load(r.state)
                for name in dict.fromkeys(domains.used_by(json.loads(r.stmt))):
                    mask = domains.null_of(["var", name], state)
                    rows.append((r.program, r.fn, r.ctx, r.src, name, None if mask == domains.EITHER else mask == domains.OBJECT))
            yield pd.DataFrame(rows, columns=["program", "fn", "ctx", "loc", "variable", "safe"]).astype({"safe": "boolean"})

    ship(edges.sparkSession)
    schema = "program string, fn string, ctx string, loc long, variable string, safe boolean"
    return _at_statements(edges, cells).where(F.expr("get_json_object(stmt, '$.k') NOT IN ('xcall', 'skip')")).mapInPandas(run, schema)
