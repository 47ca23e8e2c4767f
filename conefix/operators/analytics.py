"""Latency analytics: percentiles, group means, empirical distributions, and tables by program and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conefix.operators import scans
from conefix.session import Scratch


#: How far a bracket reaches to either side of its point, as a share of the rows, and the sketches' accuracy.
BRACKET, ACCURACY = 0.001, 10_000


def percentiles(log: DataFrame, by: list[str], ms: str = "ms", points: dict[str, float] | None = None) -> DataFrame:
    """Mean, median, p90, p95, p99 by exact linear interpolation, from the two order statistics around each.

    A first scan sketches each group and brackets its points; a second counts exactly what lies below each
    bracket and passes on only the different values within, with their numbers. So two scans shuffle a few rows of each group,
    not the log. A point whose bracket turns out to miss it is taken from the whole group. Null measures do not count.
    """
    points = points or {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    scratch = Scratch(log.sparkSession, "percentiles")
    rows = log.where(F.col(ms).isNotNull()).select(*by, F.col(ms).alias("\0ms"))
    ends = [e for p in points.values() for e in (min(1.0, max(0.0, p + d)) for d in (-BRACKET, BRACKET))]
    sketched = rows.groupBy(*by).agg(F.avg("\0ms").alias("mean"), F.count("*").alias("\0n"), F.percentile_approx("\0ms", ends, ACCURACY).alias("\0ends"))
    brackets = scratch.save(sketched, "brackets")
    places = F.array(*(F.struct(F.lit(name).alias("point"), ((F.col("\0n") - 1) * p).alias("place"), F.col("\0ends")[2 * i].alias("low"), F.col("\0ends")[2 * i + 1].alias("high")) for i, (name, p) in enumerate(points.items())))
    wanted = brackets.select(*(F.col(c).alias(f"\0by{i}") for i, c in enumerate(by)), places.alias("\0points"))
    same = [F.col(c).eqNullSafe(F.col(f"\0by{i}")) for i, c in enumerate(by)]

    def found(points_of: DataFrame) -> DataFrame:
        """``by + (point, place, here, next)``: the order statistics at and behind each place; null where its bracket misses them."""
        # Below a bracket a row is a count; within, a value. Both are combined before the shuffle.
        parts = rows.join(points_of, same).select(*by, "\0ms", F.explode("\0points").alias("p")).where("`\0ms` <= p.high")
        inside = F.when(F.col("\0ms") >= F.col("p.low"), F.col("\0ms"))
        parts = parts.groupBy(*by, F.col("p.point").alias("point"), F.col("p.place").alias("place"), inside.alias("v")).agg(F.count("*").alias("c"))
        ranked = scans.running(parts, [*by, "point"], ["v"], {"before": F.col("c")})  # what is below comes first, as null
        low = F.floor(F.col("place"))
        covers = lambda at: F.col("v").isNotNull() & (F.col("before") <= at) & (F.col("before") + F.col("c") > at)
        return ranked.groupBy(*by, "point", "place").agg(F.max(F.when(covers(low), F.col("v"))).alias("here"), F.max(F.when(covers(low + 1), F.col("v"))).alias("next"))

    first = scratch.save(found(wanted), "found")
    lacks = F.col("here").isNull() | F.col("next").isNull() & (F.col("place") > F.floor("place"))
    missed = first.where(lacks)
    exact = first.where(~lacks)
    if not missed.isEmpty():
        whole = missed.groupBy(*by).agg(F.collect_list(F.struct("point", "place", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))).alias("\0points"))
        again = whole.select(*(F.col(c).alias(f"\0by{i}") for i, c in enumerate(by)), "\0points")
        exact = exact.unionByName(found(again))
    value = F.col("here") + F.coalesce((F.col("place") - F.floor("place")) * (F.col("next") - F.col("here")), F.lit(0.0))
    wide = exact.groupBy(*by).agg(*(F.max(F.when(F.col("point") == name, value)).alias(name) for name in points))
    out = brackets.select(*(F.col(c).alias(f"\0by{i}") for i, c in enumerate(by)), "mean").join(wide, same)
    return out.select(*by, "mean", *points)


def group_means(log: DataFrame, by: list[str], order: list[str], n: int, ms: str = "ms") -> DataFrame:
    """Mean of each n consecutive rows; an incomplete last group is dropped."""
    placed = grouped_ranks(log.select(*dict.fromkeys([*by, *order]), F.col(ms).alias("\0ms")), by, order)
    groups = placed.select(*by, "\0ms", F.floor(F.col("\0rank") / n).alias("grp"))
    return groups.groupBy(*by, "grp").agg(F.avg("\0ms").alias("mean_ms"), F.count("*").alias("\0n")).where(F.col("\0n") == n).drop("\0n")


def grouped_ranks(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with ``\0rank``, their position from 0 within their group; a hot group is spread over ranges like any other."""
    placed = ranked(rows, [*by, *order], "\0at")
    first = placed.groupBy(*by).agg(F.min("\0at").alias("\0first"))
    return placed.join(first, by).withColumn("\0rank", F.col("\0at") - F.col("\0first")).drop("\0at", "\0first")


def ranked(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their position from 0 in a total order, without one task that sorts them all.

    Rows are dealt by ranges and written once; positions in a range are added to the
    counts of the ranges before it. ``order`` must not have ties.
    """
    scratch = Scratch(rows.sparkSession, "ranked")
    held = scratch.save(rows.repartitionByRange(*order).withColumn("\0range", F.spark_partition_id()), "ranges")
    counts = held.groupBy("\0range").agg(F.count("*").alias("\0n"))
    # One row for each range; its number is that of the partitions.
    before = counts.select("\0range", F.coalesce(F.sum("\0n").over(Window.orderBy("\0range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("\0before"))
    inner = F.row_number().over(Window.partitionBy("\0range").orderBy(*order)) - 1
    return held.withColumn("\0inner", inner).join(before, "\0range").withColumn(name, F.col("\0before") + F.col("\0inner")).drop("\0range", "\0inner", "\0before")


def cdf(log: DataFrame, order: list[str], ms: str = "ms") -> DataFrame:
    """``(ms, share)``: share is the part of observations before this one, so it starts at 0."""
    rows = ranked(log.select(*order, F.col(ms).alias("ms")) if ms not in order else log.select(*order), order)
    total = log.agg(F.count("*").alias("\0total"))
    return rows.crossJoin(F.broadcast(total)).select(*(c for c in rows.columns if c != "rank"), (F.col("rank") / F.col("\0total")).alias("share"))


def mode_table(log: DataFrame, program: str, mode: str, modes: list[str], ms: str = "ms") -> DataFrame:
    """A row for each program, the mean of each mode as a column."""
    return log.groupBy(program).pivot(mode, modes).agg(F.avg(ms))


def percent_of(log: DataFrame, program: str, mode: str, base: str, ms: str = "ms") -> DataFrame:
    """Each mode's total as a percentage of the base mode's, by program and over all programs (null program)."""
    totals = log.rollup(program, mode).agg(F.sum(ms).alias("total"), F.grouping(mode).alias("\0all")).where(F.col("\0all") == 0).drop("\0all")
    overall = log.groupBy(mode).agg(F.sum(ms).alias("total")).select(F.lit(None).cast(log.schema[program].dataType).alias(program), mode, "total")
    rows = totals.where(F.col(program).isNotNull()).unionByName(overall)
    ground = rows.where(F.col(mode) == base).select(F.col(program).alias("\0program"), F.col("total").alias("base"))
    return rows.join(ground, F.col(program).eqNullSafe(F.col("\0program"))).select(program, mode, (100 * F.col("total") / F.col("base")).alias("percent"))


def shown_percent(value: Column) -> Column:
    """A percentage as tables print it."""
    return F.when(value.isNull(), "").when(value < 0.01, "<0.01").when(value < 0.1, "<0.1").otherwise(F.format_string("%.1f", value))


def pasted(log: DataFrame, seed: str, order: list[str], seeds: list, ms: str = "ms") -> DataFrame:
    """``(row, one column for each seed)``: the seeds' observations side by side by row number, 0 where one has fewer."""
    placed = grouped_ranks(log.select(*dict.fromkeys([seed, *order]), F.col(ms).alias("\0ms")), [seed], order)
    wide = placed.groupBy(F.col("\0rank").alias("row")).pivot(seed, seeds).agg(F.first("\0ms"))
    return wide.select("row", *(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(str(s)) for s in seeds))


def map_total(metrics: Column) -> Column:
    """The sum of a map's numbers; nulls count nothing."""
    return F.aggregate(F.map_values(metrics), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long"))


def line_counts(lines: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """``by + (total, distinct, runs)``: lines, different lines, and runs of equal neighbours."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    marked = lines.withColumn("\0new", first | ~before.eqNullSafe(F.col(value)))
    return marked.groupBy(*by).agg(F.count("*").alias("total"), F.countDistinct(value).alias("distinct"), F.count_if("\0new").alias("runs"))
