"""Linear paths along next pointers, by pointer doubling.

Every round doubles how far each node sees, so a path of n nodes takes about log n rounds,
however long it is. A node with more than one pointer is a fork and ends the paths that
reach it; nodes that still move after as many rounds as there can be steps are led round a circle.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.session import Scratch


def linear_paths(pointers: DataFrame) -> DataFrame:
    """``pointers(src, dst)`` -> ``(node, end, length, kind)``; kind is end, fork or cycle (then end and length are null)."""
    scratch = Scratch(pointers.sparkSession, "paths")
    links = pointers.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    degree = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"), F.min("dst").alias("to"))
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    moves = F.col("out") == 1
    start = nodes.join(degree, "node", "left").select("node", F.when(moves, F.col("to")).otherwise(F.col("node")).alias("to"), F.when(moves, 1).otherwise(0).cast("long").alias("steps"), F.coalesce(F.col("out") > 1, F.lit(False)).alias("fork"))
    current = scratch.save(start, "jump-0")
    stops = scratch.save(current.where("steps = 0").select("node", "fork"), "stops")
    total = current.count()
    open_nodes, done = current.where("steps > 0"), []
    for turn in itertools.count(1):
        # A path that has come to a stop is finished and leaves; the others jump twice as far.
        ended = open_nodes.join(stops.select(F.col("node").alias("to"), F.col("fork").alias("at_fork")), "to").select("node", "to", "steps", "at_fork")
        done.append(scratch.save(ended, f"ended-{turn}"))
        rest = open_nodes.join(stops.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to", "steps")
        if rest.isEmpty() or 1 << (turn - 1) > total:
            break
        seen = _known([open_nodes, *done[:-1]]).select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        open_nodes = scratch.save(rest.join(seen, "to").select("node", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), f"jump-{turn}")
    circling = rest.select("node", F.lit(None).cast(pointers.schema["dst"].dataType).alias("end"), F.lit(None).cast("long").alias("length"), F.lit("cycle").alias("kind"))
    kind = lambda c: F.when(F.col(c), "fork").otherwise("end")
    found = _known(done).select("node", F.col("to").alias("end"), F.col("steps").alias("length"), kind("at_fork").alias("kind"))
    still = stops.select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("length"), kind("fork").alias("kind"))
    return found.unionByName(still).unionByName(circling)


def _known(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
