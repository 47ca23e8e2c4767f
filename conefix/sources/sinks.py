"""Text sinks: graphs as DOT, summaries, statistics, latency logs, CSV and LaTeX rows.

Each returns a frame of lines (or rows) in an order that ``write_lines`` keeps; rendering
pictures is left to other tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A DOT string."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"([\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))


def dot(nodes: DataFrame, edges: DataFrame, graph: str = "graph") -> DataFrame:
    """``nodes(graph, node, label, color)`` and ``edges(graph, src, dst, label)`` -> ``(graph, rank, line)`` of one digraph for each graph."""
    ids = nodes.select(F.col(graph).alias("graph")).union(edges.select(graph)).distinct()
    head = ids.select("graph", F.lit(0).alias("rank"), F.concat(F.lit("digraph "), quoted(F.col("graph")), F.lit(" {")).alias("line"))
    foot = ids.select("graph", F.lit(3).alias("rank"), F.lit("}").alias("line"))
    style = F.concat(F.lit(" [label="), quoted(F.coalesce("label", F.lit(""))), F.coalesce(F.concat(F.lit(", fillcolor="), quoted(F.col("color")), F.lit(", style=filled")), F.lit("")), F.lit("];"))
    points = nodes.select(F.col(graph).alias("graph"), F.lit(1).alias("rank"), F.concat(F.lit("  "), quoted(F.col("node").cast("string")), style).alias("line"))
    arrow = F.concat(F.lit("  "), quoted(F.col("src").cast("string")), F.lit(" -> "), quoted(F.col("dst").cast("string")), F.lit(" [label="), quoted(F.coalesce("label", F.lit(""))), F.lit("];"))
    arrows = edges.select(F.col(graph).alias("graph"), F.lit(2).alias("rank"), arrow.alias("line"))
    return head.unionByName(points).unionByName(arrows).unionByName(foot).distinct()


def cfg_dot(edges: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """Control-flow graphs, one for each method; with ``between(src_fn, dst_fn)`` one graph of all, with calls from entry to entry."""
    name = F.col("fn") if between is None else F.lit("program")
    label = lambda c: F.concat_ws("@", F.col(c), "fn") if between is not None else F.col(c).cast("string")
    arrows = edges.select(name.alias("graph"), label("src").alias("src"), label("dst").alias("dst"), F.get_json_object("stmt", "$.k").alias("label"))
    if between is not None:
        calls = between.select(F.lit("program").alias("graph"), F.concat(F.lit("0@"), "src_fn").alias("src"), F.concat(F.lit("0@"), "dst_fn").alias("dst"), F.lit("enters").alias("label"))
        arrows = arrows.unionByName(calls)
    points = arrows.select("graph", F.col("src").alias("node")).union(arrows.select("graph", "dst")).distinct()
    return dot(points.select("graph", "node", F.col("node").alias("label"), F.lit(None).cast("string").alias("color")), arrows)


def cells_dot(cells: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """One graph for each (method, context): filled cells green with their state, empty ones white; of ``limit`` contexts at most."""
    contexts = cells.select("program", "fn", "ctx").distinct()
    if limit is not None:
        contexts = contexts.orderBy("program", "fn", "ctx").limit(limit)
    name = F.concat_ws(" ", "program", "fn", F.substring("ctx", 1, 8))
    arrows = edges.join(contexts, ["program", "fn"]).select(name.alias("graph"), "ctx", "program", "fn", "src", "dst", F.get_json_object("stmt", "$.k").alias("label"))
    points = arrows.select("graph", "program", "ctx", F.col("src").alias("loc")).union(arrows.select("graph", "program", "ctx", "dst")).distinct()
    states = cells.select("program", "ctx", "loc", "state")
    filled = points.join(states, ["program", "ctx", "loc"], "left").select("graph", F.col("loc").alias("node"), F.concat_ws(": ", "loc", "state").alias("label"), F.when(F.col("state").isNotNull(), "palegreen").otherwise("white").alias("color"))
    return dot(filled, arrows)


def call_graph_dot(calls: DataFrame) -> DataFrame:
    arrows = calls.select(F.lit("calls").alias("graph"), F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("").alias("label"))
    points = arrows.select("graph", F.col("src").alias("node")).union(arrows.select("graph", "dst")).distinct()
    return dot(points.select("graph", "node", F.col("node").alias("label"), F.lit(None).cast("string").alias("color")), arrows)


def call_graph_lines(calls: DataFrame) -> DataFrame:
    """``(caller, rank, line)``: the text form that ``facts.call_graph`` reads."""
    heads = calls.select("caller").distinct().select("caller", F.lit("").alias("rank"), F.concat(F.lit("CALLER: "), "caller").alias("line"))
    return heads.unionByName(calls.distinct().select("caller", F.col("callee").alias("rank"), F.concat(F.lit("\tCALLEE: "), "callee").alias("line")))


def summaries(cells: DataFrame, limit: int = 100) -> DataFrame:
    """``{entry} method {exit}`` of solved contexts, ``limit`` at most, in order."""
    solved = cells.where("loc = 1 AND state IS NOT NULL")
    return solved.orderBy("program", "fn", "entry").limit(limit).select(F.format_string("{%s} %s {%s}", "entry", "fn", "state").alias("line"))


def stats(solved: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row: contexts, dependencies, methods, cells, filled cells, contexts that ask for themselves."""
    ask = F.substring_index("asked", "|", 1)
    counts = solved.agg(
        F.countDistinct("program", "ctx").alias("contexts"),
        F.count_if(F.col("kind") == "ask").alias("dependencies"),
        F.countDistinct("program", "fn").alias("methods"),
        F.count_if((F.col("kind") == "cell") & F.col("state").isNotNull()).alias("filled"),
        F.count_if((F.col("kind") == "ask") & (ask == F.col("ctx"))).alias("self_loops"),
    )
    contexts = solved.select("program", "fn", "ctx").distinct().join(bodies.select("program", "fn", "edges"), ["program", "fn"])
    ends = contexts.select("program", "ctx", F.explode("edges").alias("e")).select("program", "ctx", F.explode(F.array(F.get_json_object("e", "$.src"), F.get_json_object("e", "$.dst"))).alias("loc"))
    return counts.crossJoin(ends.distinct().agg(F.count("*").alias("cells")))  # two single rows


def latency_lines(log: DataFrame, ms: str = "ms") -> DataFrame:
    return log.select("*", F.format_string("%.3f", F.col(ms)).alias("line"))


def csv_rows(means: DataFrame, program: str, modes: list[str]) -> DataFrame:
    return means.select(program, F.concat_ws(",", *(F.when(F.col(m).isNull(), "").otherwise(F.format_string("%.3f", F.col(m))) for m in modes)).alias("line"))


def latex_rows(means: DataFrame, program: str, modes: list[str]) -> DataFrame:
    """A row for each program and, last, one of the averages."""
    average = means.agg(*(F.avg(m).alias(m) for m in modes)).select(F.lit("average").alias(program), *modes, F.lit(1).alias("last"))
    rows = means.select(F.col(program).cast("string").alias(program), *modes, F.lit(0).alias("last")).unionByName(average)
    cells = [F.when(F.col(m).isNull(), "--").when(F.col(m) < 0.1, "$<$0.1").otherwise(F.format_string("%.1f", F.col(m))) for m in modes]
    name = F.regexp_replace(program, r"([_&%#$])", r"\\$1")
    return rows.select("last", program, F.concat(F.concat_ws(" & ", name, *cells), F.lit(r" \\")).alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines as text files whose names follow the order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
