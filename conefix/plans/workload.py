"""Random workloads: seeded edits of synthetic methods, and queries of random locations.

Everything follows from (seed, edit number) by hashes, so a workload of any length is made
in parallel and is the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of edits: plain statements, calls, conditionals, loops (fixed values).
SHARES = (("statement", 0.75), ("call", 0.10), ("if", 0.10), ("loop", 0.05))
VARIABLES = 8


def draw(seed: int, salt: str, n: int | Column) -> Column:
    """A whole number below n, for each row's ``edit_no``."""
    return F.pmod(F.xxhash64("edit_no", F.lit(seed), F.lit(salt)), n if isinstance(n, Column) else F.lit(n))


def edits(spark: SparkSession, n: int, seed: int, methods: int = 4) -> DataFrame:
    """``(edit_no, kind, method, place, text)``: a statement to put at a random place of a random method."""
    rows = spark.range(n).withColumnRenamed("id", "edit_no")
    part, kind, low = draw(seed, "kind", 10_000) / 10_000, F.lit(SHARES[-1][0]), sum(s for _, s in SHARES[:-1])
    for name, share in reversed(SHARES[:-1]):
        kind = F.when(part < low, F.lit(name)).otherwise(kind)
        low -= share
    var = lambda salt: F.concat(F.lit("v"), draw(seed, salt, VARIABLES))
    value = F.when(draw(seed, "form", 3) == 0, draw(seed, "number", 100).cast("string")).otherwise(F.concat(var("left"), F.element_at(F.array(*map(F.lit, (" + ", " - ", " * "))), (draw(seed, "op", 3) + 1).cast("int")), draw(seed, "right", 10)))
    plain = F.concat(var("target"), F.lit(" = "), value, F.lit(";"))
    guard = F.concat(F.lit("("), var("guard"), F.lit(" < "), draw(seed, "bound", 100), F.lit(") { "), plain, F.lit(" }"))
    call = F.concat(var("target"), F.lit(" = m"), draw(seed, "callee", methods), F.lit("("), var("argument"), F.lit(");"))
    text = F.when(kind == "statement", plain).when(kind == "call", call).when(kind == "if", F.concat(F.lit("if "), guard)).otherwise(F.concat(F.lit("while "), guard))
    return rows.select("edit_no", kind.alias("kind"), draw(seed, "method", methods).alias("method"), draw(seed, "place", 1 << 30).alias("place"), text.alias("text"))


def demands(spark: SparkSession, n: int, seed: int, methods: int = 4) -> DataFrame:
    """``(edit_no, program, fn, entry)``: a query of a random method under a random entry state, after each of n edits."""
    rows = spark.range(n).withColumnRenamed("id", "edit_no")
    number = draw(seed, "query", methods)
    low = draw(seed, "low", 100) - 50
    entry = F.when(draw(seed, "open", 4) == 0, "{}").otherwise(F.format_string('{"v0": [%d.0, %d.0]}', low, low + draw(seed, "width", 20)))
    return rows.select("edit_no", F.lit("synthetic").alias("program"), F.format_string("M%d#m%d(int)", number, number).alias("fn"), entry.alias("entry"))


def program(edit_rows: DataFrame, upto: int, methods: int = 4) -> DataFrame:
    """``(program, path, text)``: the synthetic class after the first ``upto`` edits, one static method for each number.

    A statement's place orders it within its method, so each edit inserts one at a random position.
    """
    body = edit_rows.where(F.col("edit_no") < upto).groupBy("method").agg(F.sort_array(F.collect_list(F.struct("place", "edit_no", "text"))).alias("s"))
    every = edit_rows.sparkSession.range(methods).withColumnRenamed("id", "method").join(body, "method", "left")
    start = "".join(f"int v{i} = {i}; " for i in range(1, VARIABLES))
    lines = F.array_join(F.transform(F.coalesce("s", F.array().cast("array<struct<place:bigint,edit_no:bigint,text:string>>")), lambda x: x["text"]), "\n")
    text = F.concat(F.lit("class M"), F.col("method"), F.lit(" { static int m"), F.col("method"), F.lit(f"(int v0) {{ {start}\n"), lines, F.lit("\nreturn v0; } }"))
    return every.select(F.lit("synthetic").alias("program"), F.concat(F.lit("M"), "method", F.lit(".java")).alias("path"), text.alias("text"))
