"""Running sums and fill-forward within groups, without a group in one task.

Rows are dealt by ranges of group and order and written once. Within a range a window does
the work, so what a task holds is bounded by the range; what comes before it is
added from the totals of the earlier ranges. At most one group goes on from one range
into the next, so the rows to be added are fewer than the ranges and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conefix.session import Scratch


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, descending: bool = False) -> DataFrame:
    """``rows`` with a column for each of ``sums``, what the rows before add up to, and of ``last``, the last value so far that is not null.

    Groups may have null keys. Rows that are equal in ``by`` and ``order`` are taken in any order.
    """
    scratch = Scratch(rows.sparkSession, "running", spread=True)
    values = {f"\0{n}": c for n, c in ((sums or {}) | (last or {})).items()}
    direction = (lambda c: F.col(c).desc_nulls_last()) if descending else F.col
    tagged = rows.withColumns(values | {"\0tag": F.monotonically_increasing_id()})
    dealt = tagged.repartitionByRange(*(F.col(c) for c in by), *(direction(c) for c in order), "\0tag")
    held = scratch.save(dealt.withColumn("\0range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy("\0range", *by).orderBy(*(direction(c) for c in order), "\0tag")
    before, upto = group.rowsBetween(Window.unboundedPreceding, -1), group.rowsBetween(Window.unboundedPreceding, 0)
    inner = {n: F.sum(f"\0{n}").over(before) for n in sums or {}} | {n: F.last(f"\0{n}", True).over(upto) for n in last or {}}
    # What each range has of a group, and from it what the ranges before have.
    place = F.struct(*order, "\0tag")
    totals = held.groupBy("\0range", *by).agg(
        F.count("*").alias("\0rows"),
        *(F.sum(f"\0{n}").alias(f"\0{n}") for n in sums or {}),
        *((F.min_by if descending else F.max_by)(f"\0{n}", F.when(F.col(f"\0{n}").isNotNull(), place)).alias(f"\0{n}") for n in last or {}),
    )
    earlier = Window.partitionBy(*by).orderBy("\0range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "\0range", *(F.col(c).alias(f"\0by{i}") for i, c in enumerate(by)), F.sum("\0rows").over(earlier).alias("\0some"),
        *(F.sum(f"\0{n}").over(earlier).alias(f"\0+{n}") for n in sums or {}), *(F.last(f"\0{n}", True).over(earlier).alias(f"\0+{n}") for n in last or {}),
    ).where(F.col("\0some").isNotNull())
    same = [F.col(c).eqNullSafe(F.col(f"\0by{i}")) for i, c in enumerate(by)]
    joined = held.withColumns(inner).withColumnRenamed("\0range", "\0at").join(F.broadcast(carried), [F.col("\0at") == F.col("\0range"), *same], "left")
    out = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"\0+{n}"), F.lit(0)) for n in sums or {}} | {n: F.coalesce(F.col(n), F.col(f"\0+{n}")) for n in last or {}}
    return joined.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def fill_forward(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last value of its group so far that is not null."""
    return running(rows, by, order, last={name: value})


def running_offset(rows: DataFrame, by: list[str], order: list[str], size: Column, name: str) -> DataFrame:
    """``rows`` with the sum of the sizes before it in its group."""
    return running(rows, by, order, sums={name: size})
