"""Calls between procedures as joins: arguments to parameters, results to call sites, writes through aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind(links: DataFrame, actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """``links(site, callee)``, ``actuals(site, pos, lo, hi)``, ``formals(callee, pos, name, rest)`` -> ``(site, callee, var, lo, hi)``.

    Positions count from 0. The last parameter may take the ``rest`` of the arguments: they are the cells
    ``name[0], name[1], ...`` of an array whose length is the variable ``name.#``. A parameter without an argument is open.
    """
    rest = formals.where("rest").select("callee", F.col("pos").alias("from"), F.col("name").alias("packed"))
    plain = links.join(formals.where("NOT rest").select("callee", "pos", "name"), "callee").join(actuals, ["site", "pos"]).select("site", "callee", F.col("name").alias("var"), "lo", "hi")
    taken = links.join(rest, "callee").join(actuals, "site", "left").withColumn("k", F.when(F.col("pos") >= F.col("from"), F.col("pos") - F.col("from")))
    cells = taken.where("k IS NOT NULL").select("site", "callee", F.concat("packed", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("var"), "lo", "hi")
    sizes = taken.groupBy("site", "callee", "packed").agg(F.count("k").cast("double").alias("lo"))
    lengths = sizes.select("site", "callee", F.concat("packed", F.lit(".#")).alias("var"), "lo", F.col("lo").alias("hi"))
    return plain.unionByName(cells).unionByName(lengths)


def returned(links: DataFrame, exits: DataFrame) -> DataFrame:
    """``exits(callee, lo, hi)`` -> ``(site, lo, hi)``: the join over all callees of a site, open where one of them has no exit state."""
    met = links.join(exits.withColumn("known", F.lit(True)), "callee", "left")
    joined = met.groupBy("site").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all"))
    return joined.select("site", *(F.when(F.col("all"), F.col(c)).alias(c) for c in ("lo", "hi")))


def store(heap: DataFrame, points_to: DataFrame, writes: DataFrame) -> DataFrame:
    """``heap(address, field, lo, hi)`` after ``writes(var, field, lo, hi)`` through ``points_to(var, address)``.

    A variable of one address overwrites what is there; one of several may have written to each, so the
    values are joined. Several writes to one cell are joined, whatever their order.
    """
    one = points_to.groupBy("var").agg((F.count("*") == 1).alias("sure"))
    reached = writes.join(one, "var").join(points_to, "var").groupBy("address", "field").agg(F.min("lo").alias("\0lo"), F.max("hi").alias("\0hi"), F.max("sure").alias("\0sure"))
    both = heap.join(reached, ["address", "field"], "full_outer")
    old = ~F.coalesce("\0sure", F.lit(False))
    bound = lambda f, c: f(F.when(old, F.col(c)), F.col(f"\0{c}"))
    return both.select("address", "field", bound(F.least, "lo").alias("lo"), bound(F.greatest, "hi").alias("hi"))
