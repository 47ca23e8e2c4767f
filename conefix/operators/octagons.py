"""Octagons as tables: bounds on differences of signed variables, for any number of states at once.

A row ``(state keys, i, j, c)`` says ``v[i] - v[j] <= c``, where ``v[2k]`` is the k-th variable and
``v[2k + 1]`` its negation; so ``(2k, 2k + 1)`` bounds twice a variable. A missing row is no bound. Shortest
paths between signed variables are a min-plus join of the table with itself, whose rounds send only
rows that have become smaller; a state has at most 4 n ** 2 rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.session import Scratch


def opposite(i: Column) -> Column:
    """The index of the negation."""
    return F.when(i % 2 == 0, i + 1).otherwise(i - 1)


def from_points(rows: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """The least octagon around the points of each group, closed: one aggregation, without a join."""
    signed = [s * F.col(v).cast("double") for v in variables for s in (1, -1)]
    entries = [(i, j) for i in range(len(signed)) for j in range(len(signed)) if i != j]
    tops = rows.groupBy(*by).agg(*(F.max(signed[i] - signed[j]).alias(f"\0{i}_{j}") for i, j in entries))
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"\0{i}_{j}").alias("c")) for i, j in entries))
    return tops.select(*by, F.inline(cells)).where("c IS NOT NULL")


def join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Bounds that both have, the looser ones; both sides closed, and none empty."""
    both = left.join(right.withColumnRenamed("c", "\0c"), [*by, "i", "j"])
    return both.select(*by, "i", "j", F.greatest("c", "\0c").alias("c"))


def join_all(states: DataFrame, by: list[str], state: str) -> DataFrame:
    """Join of the closed states of each group: bounds that all members have."""
    members = states.groupBy(*by).agg(F.countDistinct(state).alias("\0n"))
    merged = states.groupBy(*by, "i", "j").agg(F.max("c").alias("c"), F.count("*").alias("\0have"))
    return merged.join(members, by).where(F.col("\0have") == F.col("\0n")).drop("\0n", "\0have")


def meet(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The tighter of all bounds; not closed."""
    columns = [*by, "i", "j", "c"]
    return left.select(columns).unionByName(right.select(columns)).groupBy(*by, "i", "j").agg(F.min("c").alias("c"))


def widen(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Old bounds that the new state keeps; not to be closed, so that chains end."""
    kept = old.join(new.withColumnRenamed("c", "\0c"), [*by, "i", "j"])
    return kept.where(F.col("\0c") <= F.col("c")).select(*by, "i", "j", "c")


def assumed(x: int, sign_x: int, bound: Column, y: int | None = None, sign_y: int = 1) -> Column:
    """Entries ``array<struct<i, j, c>>`` of ``sign_x * x <= bound`` or, with a second variable, ``sign_x * x + sign_y * y <= bound``; variables by number."""
    i = 2 * x + (0 if sign_x > 0 else 1)
    entry = lambda a, b, c: F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), c.cast("double").alias("c"))
    if y is None:
        return F.array(entry(i, i ^ 1, 2 * bound))
    j = 2 * y + (1 if sign_y > 0 else 0)
    return F.array(entry(i, j, bound), entry(j ^ 1, i ^ 1, bound))


def closed(states: DataFrame, by: list[str]) -> DataFrame:
    """Shortest paths between all signed variables, then what bounds of both ends imply together.

    An empty state has a row (i, i) with a negative c; others have no such rows.
    """
    scratch = Scratch(states.sparkSession, "octagons")
    key = [*by, "i", "j"]
    current = scratch.save(states.groupBy(*key).agg(F.min("c").alias("c")).withColumn("new", F.lit(True)), "paths-0")
    for turn in itertools.count(1):
        # Paths of an edge of the newest rows and any known one, on either side.
        left = current.select(*by, "i", F.col("j").alias("k"), F.col("c").alias("a"), F.col("new").alias("p"))
        right = current.select(*by, F.col("i").alias("k"), "j", F.col("c").alias("b"), F.col("new").alias("q"))
        longer = left.join(right, [*by, "k"]).where("p OR q").groupBy(*key).agg(F.min(F.col("a") + F.col("b")).alias("offer")).where("i != j OR offer < 0")
        better = current.drop("new").join(longer, key, "full_outer")
        less = F.coalesce(F.col("offer") < F.col("c"), F.col("c").isNull())
        following = scratch.save(better.select(*key, F.least("c", "offer").alias("c"), less.alias("new")), f"paths-{turn}")
        scratch.drop(f"paths-{turn - 1}")
        current = following
        # A negative circle would go on for ever: its state is empty, and done.
        empty = current.where("i = j AND c < 0").select(*by).distinct()
        if current.where("new").join(empty, by, "left_anti").isEmpty():
            break
        current = current.join(empty.withColumn("\0empty", F.lit(True)), by, "left").withColumn("new", F.col("new") & F.col("\0empty").isNull()).drop("\0empty")
    paths = current.drop("new")
    own = paths.where(F.col("j") == opposite(F.col("i")))
    first, second = own.select(*by, "i", F.col("c").alias("a")), own.select(*by, F.col("j").alias("j"), F.col("c").alias("b"))
    implied = first.join(second, by).where("i != j").select(*by, "i", "j", ((F.col("a") + F.col("b")) / 2).alias("c"))
    return meet(paths, implied, by)


def is_empty(states: DataFrame, by: list[str]) -> DataFrame:
    """``by + (empty)`` of closed states."""
    return states.groupBy(*by).agg(F.max((F.col("i") == F.col("j")) & (F.col("c") < 0)).alias("empty"))


def implies(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``by + (implies)``: whether every bound of the right state holds in the closed left one."""
    checked = right.withColumnRenamed("c", "\0c").join(left, [*by, "i", "j"], "left")
    return checked.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("c") <= F.col("\0c"), F.lit(False))).alias("implies"))


def bounds(states: DataFrame, by: list[str], x: int, y: int | None = None, sign: int = 1) -> DataFrame:
    """``by + (lo, hi)`` of a variable, or of ``x + sign * y``; null where open."""
    i = 2 * x
    j = 2 * x + 1 if y is None else 2 * y + (1 if sign > 0 else 0)
    half = 2.0 if y is None else 1.0
    pick = lambda a, b: F.min(F.when((F.col("i") == a) & (F.col("j") == b), F.col("c")))
    return states.groupBy(*by).agg((-pick(i ^ 1, j ^ 1) / half).alias("lo"), (pick(i, j) / half).alias("hi"))
