"""Writes to ranges of cells: which cells a write may reach, and what they hold then.

Every range is cut into aligned blocks of a power of two, at most two of each size, and every cell
looks for its own block of each size that occurs; so cells meet ranges by equality, each pair
once, without a nested loop. Writes to one block are joined before they meet the cells, so a
hot array with many writes and many cells makes no pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.session import Scratch

#: Sizes of blocks, as powers of two.
LEVELS = 40


def blocks(lo: Column, hi: Column, levels: int = LEVELS) -> Column:
    """``array<struct<level, block>>``: the blocks that make up ``[lo, hi]``, both within 0 and 2 ** levels; empty where lo > hi."""
    a, b = lo.cast("long"), (hi + 1).cast("long")
    none = F.array().cast("array<struct<level: int, block: bigint>>")

    def step(level: Column) -> Column:
        # The half-open range [a, b) in units of this size: an odd end is a block of its own, the rest goes one size up.
        low, high = F.call_function("shiftright", a + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), F.call_function("shiftright", b, level)
        block = lambda when, at: F.when(when, F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))).otherwise(none)
        return F.concat(block((low < high) & (low % 2 == 1), low), block((low < high) & (high % 2 == 1), high - 1))

    # No block is longer than the range; one size more, as logarithms are rounded.
    sizes = F.sequence(F.lit(0), F.least(F.ceil(F.log2((b - a).cast("double"))).cast("int"), F.lit(levels)))
    return F.when(a < b, F.flatten(F.transform(sizes, step))).otherwise(none)


def reached(cells: DataFrame, writes: DataFrame, key: str, index: str) -> DataFrame:
    """``cells(key, index, ...)``, ``writes(key, first, last, lo, hi)`` -> cells that a range may reach, with the join of what is written as ``w_lo, w_hi``.

    Infinite or missing ends of a range, and ends beyond the cells, are those of the cells.
    """
    scratch = Scratch(cells.sparkSession, "ranges", spread=True)
    limits = scratch.save(cells.groupBy(key).agg(F.min(index).alias("\0least"), F.max(index).alias("\0most")), "limits")
    clipped = writes.join(limits, key).withColumns({"\0a": F.greatest(F.coalesce(F.col("first"), F.col("\0least")), F.col("\0least")) - F.col("\0least"), "\0b": F.least(F.coalesce(F.col("last"), F.col("\0most")), F.col("\0most")) - F.col("\0least")})
    cut = clipped.where(F.col("\0a") <= F.col("\0b")).select(key, "lo", "hi", F.inline(blocks(F.col("\0a"), F.col("\0b"))))
    joined = scratch.save(cut.groupBy(key, "level", "block").agg(F.min("lo").alias("w_lo"), F.max("hi").alias("w_hi")), "blocks")
    sizes = [r["level"] for r in joined.select("level").distinct().collect()]  # LEVELS numbers at most
    if not sizes:
        return cells.limit(0).withColumns({"w_lo": F.lit(0.0), "w_hi": F.lit(0.0)})
    offset = F.col(index) - F.col("\0least")
    places = F.array(*(F.struct(F.lit(s).alias("level"), F.shiftright(offset.cast("long"), s).alias("block")) for s in sorted(sizes)))
    spread = cells.join(limits, key).withColumn("\0p", F.explode(places)).select(*cells.columns, F.col("\0p.level").alias("level"), F.col("\0p.block").alias("block"))
    met = spread.join(joined, [key, "level", "block"])
    return met.groupBy(*cells.columns).agg(F.min("w_lo").alias("w_lo"), F.max("w_hi").alias("w_hi"))


def ranged_write(cells: DataFrame, writes: DataFrame, key: str, index: str) -> DataFrame:
    """``cells(key, index, lo, hi)`` after weak writes to ranges: a cell that may be written holds its own or what is written."""
    found = reached(cells.select(key, index), writes, key, index)
    both = cells.join(found, [key, index], "left")
    return both.select(key, index, F.least("lo", "w_lo").alias("lo"), F.greatest("hi", "w_hi").alias("hi"))
