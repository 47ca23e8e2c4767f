"""Procedures that call one another, solved by demand over cell graphs.

A context is a program with an entry state; its summary is the state at its exit. A call edge asks for the
summary of its callee for the state that reaches it: a known one is the answer, an unknown one
makes a new context, and the asking cells wait. A round evaluates the contexts that are new or have got an answer,
all together; nothing is computed for programs that nobody asks for, and a context that is asked for
twice is solved once. A callee without a program leaves the state open. Programs that call themselves
or one another ask for the open entry state, so contexts are finite; where all that is left waits for
itself, the answer is the open state.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.functions.interval import NEG, POS
from conefix.operators import graph
from conefix.operators.cells import _INTS, CellGraph, Values, _ended_schema, evaluate
from conefix.session import Scratch, shuffled


@dataclass
class Solved:
    """``contexts(ctx, fn, lo, hi)``, the values and graph of all contexts (their ``fn`` is the context), ``answers(callee, in_lo, in_hi, lo, hi)`` and ``asks(fn, loc, ctx, callee, lo, hi)``, who depends on what."""

    contexts: DataFrame
    graph: CellGraph
    values: Values
    answers: DataFrame
    asks: DataFrame


def _context(fn: str, lo: str, hi: str) -> Column:
    return F.concat_ws("#", F.col(fn), F.col(lo).cast("string"), F.col(hi).cast("string"))


def instances(g: CellGraph, contexts: DataFrame) -> CellGraph:
    """The cell graphs of contexts: those of their programs, named by the context."""
    named = contexts.select("ctx", "fn")
    of = lambda df: shuffled(df.join(named, "fn").withColumn("fn", F.col("ctx")).drop("ctx"))
    entries = contexts.join(g.entries.select("fn", "entry"), "fn").select(F.col("ctx").alias("fn"), "entry", "lo", "hi")
    return CellGraph(of(g.edges), of(g.locs), shuffled(entries))


def solve(g: CellGraph, exits: DataFrame, demand: DataFrame) -> Solved:
    """``g`` with edges of op call and their ``callee``; ``exits(fn, loc)``; ``demand(fn, lo, hi)`` of programs in entry states."""
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "summaries", spread=True)
    fn = g.edges.schema["fn"].dataType.simpleString()
    links = scratch.save(g.edges.where("op = 'call'").select(F.col("fn").alias("src"), F.col("callee").alias("dst")).distinct(), "links")
    parts = scratch.save(graph.strong_components(links), "components")
    ring = links.join(parts.select(F.col("node").alias("src"), F.col("component").alias("p")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("q")), "dst").where("p = q")
    ring = ring.select(F.col("src").alias("fn"), F.col("dst").alias("callee"), F.lit(True).alias("circle"))
    g = CellGraph(scratch.save(g.edges.join(ring, ["fn", "callee"], "left").withColumn("circle", F.coalesce("circle", F.lit(False))), "edges"), g.locs, g.entries)
    programs = scratch.save(g.entries.select("fn").distinct(), "programs")
    calls = scratch.save(g.edges.where("op = 'call'").select("fn", F.col("src").alias("loc"), F.when(F.col("from_iter"), "iter").otherwise("at").alias("role"), "callee", "circle"), "calls")
    contexts = scratch.save(demand.select(_context("fn", "lo", "hi").alias("ctx"), "fn", "lo", "hi").distinct(), "contexts-0")
    active = contexts
    cells = spark.createDataFrame([], f"fn string, loc long, role string, slot int, ctx {_INTS}, lo double, hi double, sends boolean")
    ended = spark.createDataFrame([], _ended_schema(instances(g, contexts)))
    answers = spark.createDataFrame([], f"callee {fn}, in_lo double, in_hi double, lo double, hi double")
    for turn in itertools.count(1):
        names = active.select(F.col("ctx").alias("fn"))
        old = Values(shuffled(cells.join(names, "fn", "left_semi")), shuffled(ended.join(names, "fn", "left_semi")), 0)
        got = evaluate(instances(g, active), kept=old, answers=answers)
        cells = scratch.save(cells.join(names, "fn", "left_anti").unionByName(got.cells.select(cells.columns)), f"cells-{turn}")
        ended = scratch.save(ended.join(names, "fn", "left_anti").unionByName(got.ended.select(ended.columns)), f"ended-{turn}")
        # Who asks for what, and what is known by now: exits that are reached, and callees that have no program.
        named = contexts.select("ctx", F.col("fn").alias("program"), F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"))
        sending = cells.where("sends AND lo <= hi").withColumnRenamed("ctx", "turn").join(named.select(F.col("ctx").alias("fn"), "program"), "fn")
        asks = sending.join(calls.withColumnRenamed("fn", "program"), ["program", "loc", "role"]).select("fn", "loc", F.col("turn").alias("ctx"), "callee", *(F.when(F.col("circle"), F.lit(b)).otherwise(F.col(c)).alias(f"in_{c}") for c, b in (("lo", NEG), ("hi", POS))))
        asks = scratch.save(asks, f"asks-{turn}")
        key = ["callee", "in_lo", "in_hi"]
        reached = cells.where("role = 'at' AND size(ctx) = 0").withColumnRenamed("ctx", "turn").join(named.withColumnRenamed("ctx", "fn"), "fn").join(exits.select(F.col("fn").alias("program"), "loc"), ["program", "loc"])
        asked = asks.select(*key).distinct()
        unknown = asked.join(programs.select(F.col("fn").alias("callee")), "callee", "left_anti").withColumns({"lo": F.lit(NEG), "hi": F.lit(POS)})
        told = reached.select(F.col("program").alias("callee"), "in_lo", "in_hi", "lo", "hi").unionByName(unknown)
        fresh = scratch.save(told.join(answers.select(key), key, "left_anti"), f"fresh-{turn}")
        waiting = asked.join(fresh.select(key), key, "left_anti").join(answers.select(key), key, "left_anti")
        begun = waiting.select(_context(*key).alias("ctx"), F.col("callee").alias("fn"), F.col("in_lo").alias("lo"), F.col("in_hi").alias("hi")).join(contexts.select("ctx"), "ctx", "left_anti")
        begun = scratch.save(begun, f"begun-{turn}")
        woken = asks.join(fresh.select(key), key, "left_semi").select("fn").distinct()
        if begun.isEmpty() and woken.isEmpty():
            waiting = scratch.save(waiting, f"circle-{turn}")
            if waiting.isEmpty():
                break
            fresh = waiting.withColumns({"lo": F.lit(NEG), "hi": F.lit(POS)})
            woken = asks.join(fresh.select(key), key, "left_semi").select("fn").distinct()
        answers = scratch.save(answers.unionByName(fresh), f"answers-{turn}")
        contexts = scratch.save(contexts.unionByName(begun.select(contexts.columns)), f"contexts-{turn}")
        active = scratch.save(contexts.join(woken.withColumnRenamed("fn", "ctx").unionByName(begun.select("ctx")).distinct(), "ctx", "left_semi"), f"active-{turn}")
    answers = answers.unionByName(fresh)
    return Solved(contexts, instances(g, contexts), Values(cells, ended, turn), answers, asks)


def located(found: Solved, places: DataFrame) -> DataFrame:
    """``places(fn, loc)`` of programs -> ``(fn, loc, lo, hi, contexts)``: the join of a location's states over all contexts that have been asked for."""
    states = found.values.at_locations(found.graph.locs).join(found.contexts.select(F.col("ctx").alias("fn"), F.col("fn").alias("program")), "fn").select(F.col("program").alias("fn"), "loc", "lo", "hi")
    return states.join(places.select("fn", "loc").distinct(), ["fn", "loc"]).groupBy("fn", "loc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("contexts"))
