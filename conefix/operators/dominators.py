"""Dominators, back edges and loops of many graphs at once.

Sets of dominators shrink from "every node" to the fixpoint; only removals are kept, as
rows, and each round sends only the newest: a node is removed from the dominators of a
target where some predecessor has lost it. Nothing is searched in depth-first order, so no graph has
to fit a task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.operators import graph
from conefix.session import Scratch


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``edges(fn, src, dst)``, ``entries(fn, entry)`` -> ``(fn, loc)`` that each entry reaches, itself included."""
    node = lambda c: F.struct(F.col("fn"), F.col(c).alias("loc"))
    found = graph.reach(edges.select(node("src").alias("src"), node("dst").alias("dst")), entries.select(F.lit(0).alias("origin"), node("entry").alias("node")))
    return found.select("node.fn", "node.loc")


def removals(edges: DataFrame, entries: DataFrame, locs: DataFrame | None = None) -> DataFrame:
    """``(fn, loc, other)``: reachable pairs where ``other`` does not dominate ``loc``; ``locs`` are the reachable ones, where they are known."""
    scratch = Scratch(edges.sparkSession, "dominators", spread=True)
    if locs is None:
        locs = scratch.save(reachable(edges, entries), "locs")
    edges = scratch.save(edges.select("fn", "src", "dst").distinct().join(locs.withColumnRenamed("loc", "src"), ["fn", "src"], "left_semi"), "edges")
    first = entries.select("fn", F.col("entry").alias("loc")).distinct().join(locs.withColumnRenamed("loc", "other"), "fn").where("loc != other")
    parts = [scratch.save(first, "removed-0")]
    for turn in itertools.count(1):
        step = parts[-1].withColumnRenamed("loc", "src").join(edges, ["fn", "src"]).where("dst != other").select("fn", F.col("dst").alias("loc"), "other").distinct()
        known = graph.rows_of(iter(parts))
        newest = scratch.save(step.join(known, ["fn", "loc", "other"], "left_anti"), f"removed-{turn}")
        if newest.isEmpty():
            return known
        parts = [*parts, newest] if len(parts) <= 16 else [scratch.save(known, f"known-{turn}"), newest]


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``(fn, loc, dominator)``, each location's own included; unreachable locations have none."""
    locs = Scratch(edges.sparkSession, "dominators", spread=True).save(reachable(edges, entries), "locs")
    pairs = locs.join(locs.withColumnRenamed("loc", "dominator"), "fn")
    return pairs.join(removals(edges, entries, locs).withColumnRenamed("other", "dominator"), ["fn", "loc", "dominator"], "left_anti")


def back_edges(edges: DataFrame, entries: DataFrame, locs: DataFrame | None = None) -> DataFrame:
    """``(fn, src, dst)`` of reachable edges whose target dominates their source, self loops among them."""
    if locs is None:
        locs = Scratch(edges.sparkSession, "dominators", spread=True).save(reachable(edges, entries), "locs")
    lost = removals(edges, entries, locs).select("fn", F.col("loc").alias("src"), F.col("other").alias("dst"))
    live = edges.select("fn", "src", "dst").distinct().join(locs.withColumnRenamed("loc", "src"), ["fn", "src"], "left_semi")
    return live.join(lost, ["fn", "src", "dst"], "left_anti")
