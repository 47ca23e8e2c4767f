"""Connected components of a distributed edge table.

Alternates the large-star and small-star steps until every edge points at the
smallest node of its component. Each round is a plan of joins and partial
aggregates over a table in the shared folder; the driver sees two numbers a
round (a count and a checksum), never an edge. Hubs are pre-aggregated before each
shuffle; joins on them are split by adaptive execution, which keeps the plans small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.session import Scratch

#: Rounds after which the loop gives up; the count grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1)).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``edges(u, v)`` of longs, any direction, loops and repeats allowed -> ``(node, root)``.

    Only nodes that some edge names appear, without the roots themselves. An
    empty edge table gives an empty result; rows with a null end are ignored.
    """
    ends = edges.where(F.col("u") != F.col("v"))
    current = scratch.save(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state = _state(current)
    for turn in range(1, MAX_ROUNDS):
        if not state[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        following = scratch.save(stars, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        current, before, state = following, state, _state(following)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
