"""Differences between two versions of a program, and recomputation of only what they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line, digest, ordinal)``: equal lines of a file are told apart by their ordinal."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("line", "value")).select("path", "line", F.md5("value").alias("digest"))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("path", "digest").orderBy("line")))


def diff_lines(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Two tables of ``numbered_lines`` -> ``(path, digest, ordinal, old_line, new_line, kind)``: shared, added or deleted."""
    a = previous.withColumnRenamed("line", "old_line")
    b = following.withColumnRenamed("line", "new_line")
    kind = F.when(F.col("old_line").isNull(), "added").when(F.col("new_line").isNull(), "deleted").otherwise("shared")
    return a.join(b, ["path", "digest", "ordinal"], "full_outer").withColumn("kind", kind)


def file_changes(previous: DataFrame, following: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, change)``: same, changed, added or deleted, by the digests of the contents."""
    a = previous.select(F.col(path).alias("path"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("a"))
    b = following.select(F.col(path).alias("path"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def method_changes(previous: DataFrame, following: DataFrame) -> DataFrame:
    """``methods(method, header, body)`` of two versions -> ``(method, edit)``; unchanged methods have no row."""
    a = previous.select("method", F.col("header").alias("h0"), F.col("body").alias("b0"))
    b = following.select("method", F.col("header").alias("h1"), F.col("body").alias("b1"))
    edit = F.when(F.col("h0").isNull(), "add_function").when(F.col("h1").isNull(), "delete_function").when(F.col("h0") != F.col("h1"), "modify_header").when(F.col("b0") != F.col("b1"), "modify_function")
    return a.join(b, "method", "full_outer").select("method", edit.alias("edit")).where("edit IS NOT NULL")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side`` first or second; sets, not bags."""
    first = left.exceptAll(right).distinct().withColumn("side", F.lit("first"))
    return first.unionByName(right.exceptAll(left).distinct().withColumn("side", F.lit("second")))


def recompute(results: DataFrame, facts: DataFrame, touched: DataFrame, key: str, compute) -> DataFrame:
    """Results of untouched keys as they were, those of touched keys computed anew from the facts.

    The facts of untouched keys are pruned before ``compute(facts)`` shuffles them.
    """
    keys = touched.select(key).distinct()
    fresh = compute(facts.join(keys, key, "left_semi"))
    return results.join(keys, key, "left_anti").unionByName(fresh)


def widened(lo: Column, hi: Column, by: list[str], order: list[str]) -> tuple[Column, Column]:
    """Bounds of a sequence of states widened one by one: a bound stays at its first value until one goes beyond it."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    low = F.when(F.min(lo).over(window) >= F.first(lo).over(window), F.first(lo).over(window)).otherwise(F.lit(float("-inf")))
    high = F.when(F.max(hi).over(window) <= F.first(hi).over(window), F.first(hi).over(window)).otherwise(F.lit(float("inf")))
    return low, high


def shifted(old: Column, new: Column, by: list[str], order: list[str]) -> Column:
    """How far the hunks before a row have moved what follows them: the sum of their new minus their old sizes."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(new - old).over(window), F.lit(0))


def contiguous(entry: Column, exit: Column, by: list[str], order: list[str]) -> Column:
    """Whether a row begins where the one before it ended; the first row of a group does."""
    window = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(F.lag(exit).over(window) == entry, F.row_number().over(window) == 1)


def neighbour(value: Column, by: list[str], order: list[str]) -> Column:
    """The value of the row before, or else of the row behind."""
    window = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(F.lag(value).over(window), F.lead(value).over(window))


def reindexed(index: Column, by: list[str], k: Column) -> Column:
    """Indices moved behind the greatest one of the group by k."""
    return F.max(index).over(Window.partitionBy(*by)) + 1 + k


def first_empty(iterates: DataFrame, by: list[str], index: str, state: str) -> DataFrame:
    """``by + (index)``: the first iterate of a group without a state; null where all have one."""
    return iterates.groupBy(*by).agg(F.min(F.when(F.col(state).isNull(), F.col(index))).alias(index))


def located(statements: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Statements of the old version whose hash and ordinal are among the changed ones: a hash finds its location."""
    return statements.join(changed.select(*keys).distinct(), keys, "left_semi")


def split_by(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows with ``is_known``: whether their key is among the known ones."""
    have = known.select(key).distinct().withColumn("\0known", F.lit(True))
    return rows.join(have, key, "left").withColumn("is_known", F.coalesce("\0known", F.lit(False))).drop("\0known")


def set_relations(members: DataFrame, pairs: DataFrame, group: str, item: str) -> DataFrame:
    """``members(group, item)`` and ``pairs(a, b)`` of groups -> ``(a, b, disjoint, subset)``: whether the sets share nothing, and whether a lies within b."""
    own = members.select(group, item).distinct()
    sizes = own.groupBy(F.col(group).alias("a")).agg(F.count("*").alias("size"))
    left, right = own.select(F.col(group).alias("a"), item), own.select(F.col(group).alias("b"), item, F.lit(1).alias("\0in"))
    shared = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", item]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = pairs.select("a", "b").distinct().join(shared, ["a", "b"], "left").join(sizes, "a", "left")
    n = F.coalesce("shared", F.lit(0))
    return both.select("a", "b", (n == 0).alias("disjoint"), (n == F.coalesce("size", F.lit(0))).alias("subset"))


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two tables by key; a key of both sides is an error when the result is read."""
    both = left.unionByName(right)
    values = [c for c in left.columns if c not in keys]
    once = both.groupBy(*keys).agg(F.count("*").alias("\0n"), *(F.first(c).alias(c) for c in values))
    clash = F.raise_error(F.concat(F.lit("a key of both sides: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return once.where(F.when(F.col("\0n") > 1, clash.cast("boolean")).otherwise(True)).select(left.columns)
