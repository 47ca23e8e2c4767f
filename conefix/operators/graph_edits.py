"""Batches of edits applied to control-flow graphs as tables.

An edit is a row; what it takes away and brings in are rows too, removed by anti-joins and added by
unions, for all graphs at once. Fresh locations are numbered by running sums over ranges of edits.
Two edits that touch one edge clash: neither is applied, and both are reported with the edge.

Kinds, each with a statement (op, a, b) of its own:

* ``add``: at ``at``, a statement leads to a fresh location, from which the old edges of ``at`` go on;
* ``modify``: what lies between ``at`` and ``upto`` becomes one statement;
* ``delete``: what lies between them goes and ``upto`` becomes ``at``; before an exit a statement that does nothing is left instead;
* ``header``: the comparisons that leave ``at`` get new bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.operators import graph, scans
from conefix.session import Scratch

KINDS = ("add", "modify", "delete", "header")
#: Statements that compare, and so have a header.
COMPARES = ("below", "above")


def between(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """``(edit, fn, src, dst)``: edges on a path from ``at`` that has not passed ``upto``, to ``upto``; all regions in one search."""
    scratch = Scratch(edges.sparkSession, "regions", spread=True)
    wanted = edits.where("upto IS NOT NULL").select("edit", "fn", "at", "upto")
    node = lambda c: F.struct(F.col("edit"), F.col(c).cast("long").alias("loc"))
    own = scratch.save(wanted.join(edges.select("fn", "src", "dst"), "fn").select("edit", "fn", "upto", "src", "dst"), "own")
    links = own.select(node("src").alias("src"), node("dst").alias("dst"))
    start = lambda c: wanted.select(F.lit(0).alias("origin"), node(c).alias("node"))
    ahead = graph.reach(links, start("at"), wanted.select(node("upto").alias("node"))).select("node.edit", F.col("node.loc").alias("src"))
    behind = graph.reach(graph.reverse(links), start("upto")).select("node.edit", F.col("node.loc").alias("dst"))
    return own.where("src != upto").join(ahead, ["edit", "src"], "left_semi").join(behind, ["edit", "dst"], "left_semi").select("edit", "fn", "src", "dst")


def touched(edges: DataFrame, edits: DataFrame, region: DataFrame) -> DataFrame:
    """``(edit, fn, src, dst)``: every edge that an edit takes away or moves; ``edits`` with ``at_exit``."""
    ends = edges.select("fn", "src", "dst", "op")
    leaving = lambda kind, c: edits.where(F.col("kind") == kind).select("edit", "fn", F.col(c).alias("src")).join(ends, ["fn", "src"])
    header = leaving("header", "at").where(F.col("op").isin(*COMPARES))
    # A collapsed location takes the edges that lead to it along; an exit stays.
    arriving = edits.where("kind = 'delete' AND NOT at_exit").select("edit", "fn", F.col("upto").alias("dst")).join(ends, ["fn", "dst"])
    rows = [leaving("add", "at"), leaving("delete", "upto"), header, arriving, region]
    return graph.rows_of(r.select("edit", "fn", "src", "dst") for r in rows).distinct()


def apply_edits(edges: DataFrame, edits: DataFrame, exits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(fn, src, dst, op, a, b)``, ``edits(edit, fn, kind, at, upto, op, a, b)``, ``exits(fn, loc)`` -> edited edges, and clashes ``(edit, fn, src, dst, edits)``.

    An edit whose kind is unknown, or whose locations do not exist, is reported without an edge.
    """
    scratch = Scratch(edges.sparkSession, "edits", spread=True)
    edits = scratch.save(edits.select("edit", "fn", "kind", F.col("at").cast("long").alias("at"), F.col("upto").cast("long").alias("upto"), "op", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).join(exits.select("fn", F.col("loc").alias("upto"), F.lit(True).alias("last")).distinct(), ["fn", "upto"], "left").withColumn("at_exit", F.coalesce("last", F.lit(False))).drop("last"), "edits")
    region = scratch.save(between(edges, edits.where("kind IN ('modify', 'delete')")), "regions")
    moved = scratch.save(touched(edges, edits, region), "touched")
    shared = moved.groupBy("fn", "src", "dst").agg(F.count("*").alias("edits")).where("edits > 1")
    clashes = scratch.save(moved.join(shared, ["fn", "src", "dst"]).select("edit", "fn", "src", "dst", "edits"), "clashes")
    sound = edits.join(moved.select("edit").distinct(), "edit", "left_semi").where(F.col("kind").isin(*KINDS))
    sound = scratch.save(sound.join(clashes.select("edit").distinct(), "edit", "left_anti"), "sound")
    lost = edits.join(sound, "edit", "left_anti").join(clashes.select("edit").distinct(), "edit", "left_anti")
    none = F.lit(None).cast("long")
    errors = clashes.unionByName(lost.select("edit", "fn", none.alias("src"), none.alias("dst"), F.lit(0).cast("long").alias("edits")))

    # Fresh locations follow the largest one of their graph, in the order of the edits.
    locs = edges.select("fn", F.greatest("src", "dst").alias("loc")).groupBy("fn").agg(F.max("loc").alias("most"))
    adds = scans.running_offset(sound.where("kind = 'add'"), ["fn"], ["edit"], F.lit(1), "k").join(locs, "fn").withColumn("fresh", F.col("most") + 1 + F.col("k"))
    adds = scratch.save(adds.select("fn", "at", "fresh", "op", "a", "b"), "adds")

    gone = region.join(sound.select("edit"), "edit", "left_semi").select("fn", "src", "dst")
    rest = edges.join(gone, ["fn", "src", "dst"], "left_anti")
    headers = sound.where("kind = 'header'").select("fn", F.col("at").alias("src"), F.col("a").alias("new_a"), F.col("b").alias("new_b"))
    compares = F.col("new_a").isNotNull() & F.col("op").isin(*COMPARES)
    rest = rest.join(headers, ["fn", "src"], "left").withColumns({"a": F.when(compares, F.col("new_a")).otherwise(F.col("a")), "b": F.when(compares, F.col("new_b")).otherwise(F.col("b"))}).drop("new_a", "new_b")
    removed = sound.where("kind = 'delete'")
    merged = removed.where("NOT at_exit").select("fn", F.col("upto").alias("loc"), F.col("at").alias("into"))
    for side in ("src", "dst"):
        rest = rest.join(merged.withColumnsRenamed({"loc": side, "into": "\0into"}), ["fn", side], "left").withColumn(side, F.coalesce("\0into", side)).drop("\0into")
    rest = rest.join(adds.select("fn", F.col("at").alias("src"), "fresh"), ["fn", "src"], "left").withColumn("src", F.coalesce("fresh", "src")).drop("fresh")
    columns = ["fn", "src", "dst", "op", "a", "b"]
    zero = F.lit(0.0)
    brought = [
        adds.select("fn", F.col("at").alias("src"), F.col("fresh").alias("dst"), "op", "a", "b"),
        sound.where("kind = 'modify'").select("fn", F.col("at").alias("src"), F.col("upto").alias("dst"), "op", "a", "b"),
        removed.where("at_exit").select("fn", F.col("at").alias("src"), F.col("upto").alias("dst"), F.lit("add").alias("op"), zero.alias("a"), zero.alias("b")),
    ]
    return graph.rows_of(r.select(columns) for r in (rest, *brought)), errors
