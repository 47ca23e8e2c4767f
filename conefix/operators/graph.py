"""Graph operators: reachability, components, loops and regions.

Cyclic reachability is a semi-naive loop: each round joins only the newest pairs
with the edges, drops those already known by an anti-join, and writes the rest to the
shared folder, so plans stay short and survive lost executors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conefix.session import Scratch, shuffled


def reach(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """``edges(src, dst)``, ``seeds(origin, node)`` -> ``(origin, node)`` of everything reachable, seeds included.

    ``stop(node)``: nodes that are reached but not left.
    """
    scratch = Scratch(edges.sparkSession, "reach", spread=True)
    edges = scratch.save(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    if stop is not None:
        edges = edges.join(stop.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    newest = scratch.save(seeds.select("origin", "node").distinct(), "new-0")
    parts = [newest]
    for turn in itertools.count(1):
        step = newest.join(edges, newest["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        known = rows_of(iter(parts))
        newest = scratch.save(step.join(known, ["origin", "node"], "left_anti"), f"new-{turn}")
        if newest.isEmpty():
            return known
        parts.append(newest)
        if len(parts) > 16:  # keep the plan short
            parts = [scratch.save(rows_of(iter(parts)), f"known-{turn}")]


def closure(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` of all pairs with a path of at least one edge."""
    first = edges.select(F.col("src").alias("origin"), F.col("dst").alias("node"))
    return reach(edges, first).select(F.col("origin").alias("src"), F.col("node").alias("dst"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _least_reached(edges: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels(node, label)`` -> the least label among each node and all that reach it; only what changed goes on.

    A step writes the labels once, with a mark where they have changed; the step before is deleted.
    """
    current = scratch.save(labels.select("node", "label", F.lit(True).alias("new")), f"{name}-0")
    for turn in itertools.count(1):
        offered = current.where("new").withColumnRenamed("node", "src").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        less = F.coalesce(F.col("offer") < F.col("label"), F.lit(False))
        following = scratch.save(current.drop("new").join(offered, "node", "left").select("node", F.when(less, F.col("offer")).otherwise(F.col("label")).alias("label"), less.alias("new")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        current = following
        if current.where("new").isEmpty():
            return current.drop("new")


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node of each node's strongly connected component.

    Rounds of colours: the least node that reaches a node is its colour; of each colour, what
    reaches the colour's own node within it is a component and leaves the graph. Nodes without
    edges in or out among the rest are components of their own and leave first. No pairs of
    nodes are made.
    """
    scratch = Scratch(edges.sparkSession, "scc", spread=True)
    rest = scratch.save(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
    done: list[DataFrame] = []
    for turn in itertools.count():
        # Trim: only nodes with edges both in and out may be on a circle.
        inner = rest.where("src != dst").select(F.col("src").alias("node")).intersect(rest.where("src != dst").select("dst"))
        rest = scratch.save(rest.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), f"trimmed-{turn}")
        if rest.isEmpty():
            break
        own = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().withColumn("label", F.col("node"))
        colours = _least_reached(rest, own, scratch, f"colour-{turn}")
        same = rest.join(colours.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        same = scratch.save(same.select("src", "dst"), f"same-{turn}")
        # Within a colour, what reaches its own node: the least of the nodes reached backwards is the colour itself.
        back = _least_reached(reverse(same), colours.select("node", F.when(F.col("node") == F.col("label"), F.col("node")).alias("label")).where("label IS NOT NULL").unionByName(colours.where("node != label").select("node", F.col("node").alias("label"))), scratch, f"back-{turn}")
        found = back.join(colours.withColumnRenamed("label", "colour"), "node").where("label = colour").select("node", F.col("colour").alias("component"))
        done.append(scratch.save(found, f"found-{turn}"))
        gone = done[-1].select("node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    out = nodes
    if done:
        whole = rows_of(iter(done))
        out = nodes.join(whole, "node", "left")
        return out.select("node", F.coalesce("component", "node").alias("component"))
    return out.select("node", F.col("node").alias("component"))


def natural_loop(edges: DataFrame, head: int, tail: int) -> DataFrame:
    """``(node)`` of the loop of the back edge tail -> head, without the head."""
    spark = edges.sparkSession
    seeds = spark.range(1).select(F.lit(0).alias("origin"), F.lit(tail).alias("node"))
    stop = spark.range(1).select(F.lit(head).alias("node"))
    return reach(reverse(edges), seeds, stop).where(F.col("node") != head).select("node")


def region(edges: DataFrame, entry: int, exit: int) -> DataFrame:
    """``(src, dst)`` edges on some path from entry that has not yet passed exit, to exit."""
    spark = edges.sparkSession
    one = lambda n: spark.range(1).select(F.lit(0).alias("origin"), F.lit(n).alias("node"))
    ahead = reach(edges, one(entry), one(exit).select("node")).select(F.col("node").alias("src")).where(F.col("src") != exit)
    behind = reach(reverse(edges), one(exit)).select(F.col("node").alias("dst"))
    return edges.select("src", "dst").distinct().join(ahead, "src", "left_semi").join(behind, "dst", "left_semi").select("src", "dst")


def back_edges(edges: DataFrame) -> DataFrame:
    """``edges(fn_id, src, dst)``, ``src = -1``-free, with an ``entry`` column -> the back edges of a depth-first search.

    The search is sequential by nature; each function's graph is small and handled as a group.
    """

    def search(group: pd.DataFrame) -> pd.DataFrame:
        follow: dict[int, list[int]] = {}
        for a, b in sorted(zip(group["src"], group["dst"], strict=True)):
            follow.setdefault(a, []).append(b)
        entry = group["entry"].iloc[0]
        state, found, stack = {entry: 1}, set(), [(entry, iter(follow.get(entry, [])))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if state.get(child) == 1:
                    found.add((node, child))
                elif child not in state:
                    state[child] = 1
                    stack.append((child, iter(follow.get(child, []))))
                    break
            else:
                state[node] = 2
                stack.pop()
        return pd.DataFrame([(group["fn_id"].iloc[0], a, b) for a, b in sorted(found)], columns=["fn_id", "src", "dst"])

    kind = edges.schema["fn_id"].dataType.simpleString()
    return edges.select("fn_id", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("entry").cast("long")).groupBy("fn_id").applyInPandas(search, f"fn_id {kind}, src long, dst long")


def edge_ordinals(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each edge with its position among those that share its target, from 0."""
    return edges.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def by_indegree(edges: DataFrame) -> DataFrame:
    """``(node, indegree, is_join)``: nodes with at least two incoming edges are joins."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    counts = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return nodes.join(counts, "node", "left").select("node", n.alias("indegree"), (n >= 2).alias("is_join"))


def inherited(edges: DataFrame, own: DataFrame) -> DataFrame:
    """``edges(child, parent)``, ``own(class_id, name)`` -> ``(class_id, name)`` with all ancestors' names."""
    up = reach(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), own.select(F.col("class_id").alias("origin"), F.col("class_id").alias("node")).union(edges.select("child", "child")).union(edges.select("parent", "parent")).distinct())
    return up.join(own.withColumnRenamed("class_id", "node"), "node").select(F.col("origin").alias("class_id"), "name").distinct()


def rows_of(frames: Iterator[DataFrame]) -> DataFrame:
    """Union by name of some frames; joins shuffle it, as Spark does not see how its parts add up."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return shuffled(first) if rest else first


def containing_heads(edges: DataFrame, back: DataFrame) -> DataFrame:
    """``edges(fn_id, src, dst)`` and their ``back`` edges -> ``(fn_id, loc, heads)``: the heads of the loops around each location, in order.

    A loop is what reaches the tail of a back edge without passing its head; the head is not within it.
    """
    kind = edges.schema["fn_id"].dataType
    node = lambda c: F.struct(F.col("fn_id"), F.col("head"), F.col(c).alias("loc"))
    heads = back.select("fn_id", F.col("dst").alias("head"), F.col("src").alias("tail")).distinct()
    backwards = edges.join(heads.select("fn_id", "head").distinct(), "fn_id").where("dst != head").select(node("dst").alias("src"), node("src").alias("dst"))
    found = reach(backwards, heads.select(F.lit(0).alias("origin"), node("tail").alias("node")))
    inside = found.select(F.col("node.fn_id").cast(kind).alias("fn_id"), F.col("node.head").alias("head"), F.col("node.loc").alias("loc")).where("loc != head").distinct()
    return inside.groupBy("fn_id", "loc").agg(F.sort_array(F.collect_list("head")).alias("heads"))
