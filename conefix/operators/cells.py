"""Analysis as a graph of cells: reference cells, the computations between them, and their values.

A cell graph has, for every location, a cell of its state, numbered cells before each
join, the first iterates of each loop and the cell before its widening, and a cell
for every statement; computations are transfer, join, widen and fix. Both are tables, made by joins.

Values flow through it round by round, for all programs at once. A round sends only cells
that the round before has filled. An instance of a cell carries the iteration of each loop
around it, outermost first, so unrolling a loop copies nothing: the next iteration of its
body is the same rows of the graph with a higher number. A loop ends where an iterate
equals the one before; what leaves it elsewhere than by its head waits at a barrier, one loop
after the other, until the loop has ended, and goes on only from the iteration that has converged.

States are intervals; the empty one is ``(inf, -inf)``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.functions.interval import NEG, POS, Itv
from conefix.operators import dominators, graph
from conefix.session import Scratch, shuffled

_INTS, _LOCS = "array<int>", "array<bigint>"


# --- the graph -----------------------------------------------------------------


@dataclass
class CellGraph:
    """``edges`` with where they lie in loops, ``locs``, and the tables of ``cells`` and ``comps``."""

    edges: DataFrame
    locs: DataFrame
    entries: DataFrame

    @property
    def cells(self) -> DataFrame:
        """``(fn, cell, kind, loc, role, slot)``; kind is state or stmt."""
        at, loop = _name("loc", "nest"), _name("loc", F.concat("nest", F.array("loc")))
        first, second = loop, _name("loc", F.concat("nest", F.array("loc")), last=1)
        state = lambda role, cell, slot=-1: F.struct(cell.alias("cell"), F.lit("state").alias("kind"), F.lit(role).alias("role"), F.lit(slot).alias("slot"))
        plain = [state("at", at)]
        heads = [*plain, state("iter", first, 0), state("iter", second, 1), state("prewiden", F.concat(first, F.lit("^"), second))]
        own = self.locs.select("fn", "loc", F.explode(F.when(F.col("is_head"), F.array(*heads)).otherwise(F.array(*plain))).alias("c")).select("fn", "c.cell", "c.kind", "loc", "c.role", "c.slot")
        joined = self.edges.where("is_join AND NOT is_back")
        pre = joined.select("fn", _pre().alias("cell"), F.lit("state").alias("kind"), F.col("dst").alias("loc"), F.lit("pre").alias("role"), F.col("i").alias("slot"))
        stmts = self.edges.select("fn", _stmt().alias("cell"), F.lit("stmt").alias("kind"), F.col("dst").alias("loc"), F.lit("stmt").alias("role"), F.when(F.col("is_join") & ~F.col("is_back"), F.col("i")).otherwise(-1).alias("slot"))
        return shuffled(own.unionByName(pre).unionByName(stmts))

    @property
    def comps(self) -> DataFrame:
        """``(fn, src, dst, kind, after)``: the inputs of each cell; ``after`` is the loop that must have ended."""
        e = self.edges
        pair = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
        head, tail = _dst_name(0), _dst_name(1)
        target = F.when(F.col("is_back"), F.concat(head, F.lit("^"), tail)).when(F.col("is_join"), _pre()).when(F.col("dst_head"), head).otherwise(_name("dst", "dst_nest"))
        after = F.when(F.size("left") > 0, F.try_element_at("left", F.lit(-1)))
        moves = e.select("fn", F.explode(F.array(pair(_stmt(), target, "transfer"), pair(_src_name(), target, "transfer"))).alias("c"), after.alias("after"))
        joins = e.where("is_join AND NOT is_back").select("fn", pair(_pre(), F.when(F.col("dst_head"), head).otherwise(_name("dst", "dst_nest")), "join").alias("c"), F.lit(None).cast("long").alias("after"))
        own = F.concat("nest", F.array("loc"))
        zero, one, fix = _name("loc", own), _name("loc", own, last=1), _name("loc", "nest")
        loops = [pair(zero, fix, "fix"), pair(one, fix, "fix"), pair(zero, one, "widen"), pair(F.concat(zero, F.lit("^"), one), one, "widen")]
        rings = self.locs.where("is_head").select("fn", F.explode(F.array(*loops)).alias("c"), F.lit(None).cast("long").alias("after"))
        return shuffled(moves.unionByName(joins).unionByName(rings)).select("fn", "c.src", "c.dst", "c.kind", "after").distinct()


def _name(loc: str, nest: Column | str, last: int = 0) -> Column:
    """The text of a location's cell: its number and, behind @, the loops around it with their iterations."""
    loops = F.col(nest) if isinstance(nest, str) else nest
    n = F.size(loops)
    marks = F.transform(loops, lambda h, i: F.concat(h.cast("string"), F.when(i == n - 1, F.lit(f":{last}")).otherwise(":0")))
    return F.concat(F.col(loc).cast("string"), F.when(n > 0, F.concat(F.lit("@"), F.array_join(marks, ","))).otherwise(""))


def _dst_name(last: int) -> Column:
    return _name("dst", F.concat("dst_nest", F.array("dst")), last)


def _src_name() -> Column:
    return F.when(F.col("from_iter"), _name("src", F.concat("src_nest", F.array("src")))).otherwise(_name("src", "src_nest"))


def _pre() -> Column:
    return F.concat(F.col("i").cast("string"), F.lit("*"), _name("dst", "dst_nest"))


def _stmt() -> Column:
    edge = F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"))
    return F.when(F.col("is_join") & ~F.col("is_back"), F.concat(F.col("i").cast("string"), F.lit("*"), edge)).otherwise(edge)


#: Edges up to which a program's graph is named by its edges, so that programs of one shape share what is found out about it.
SHAPED = 64


def build(edges: DataFrame, entries: DataFrame) -> CellGraph:
    """``edges(fn, src, dst, op, a, b)`` and ``entries(fn, entry, lo, hi)`` -> their cell graph.

    Edges are unique in (fn, src, dst); what no entry reaches is left out. Loops must be entered by their heads.
    Loops, joins and ordinals follow from (src, dst) and entries alone: they are found once for each shape. A program of more than
    ``SHAPED`` edges is a shape of its own, and none of its rows are collected.
    """
    scratch = Scratch(edges.sparkSession, "cell-graph", spread=True)
    edges = edges.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
    entries = entries.withColumn("entry", F.col("entry").cast("long"))
    big = scratch.save(edges.groupBy("fn").agg(F.count("*").alias("n")).where(F.col("n") > SHAPED).select("fn", F.lit(True).alias("big")), "big")
    arcs = edges.join(big, "fn", "left_anti").groupBy("fn").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("arcs"))
    starts = entries.groupBy("fn").agg(F.sort_array(F.collect_set("entry")).alias("starts"))
    text = F.concat(F.array_join(F.col("starts").cast("array<string>"), ","), F.lit("|"), F.array_join(F.transform(F.coalesce("arcs", F.array().cast("array<struct<src:bigint,dst:bigint>>")), lambda e: F.concat(e["src"].cast("string"), F.lit(">"), e["dst"].cast("string"))), ","))
    named = starts.join(arcs, "fn", "left").join(big, "fn", "left")
    named = scratch.save(named.select("fn", F.when(F.col("big"), F.concat(F.lit("="), F.col("fn").cast("string"))).otherwise(text).alias("shape"), "arcs", "starts"), "named")
    shapes = scratch.save(named.groupBy("shape").agg(F.first("arcs").alias("arcs"), F.first("starts").alias("starts")), "shapes")
    large = edges.join(big, "fn", "left_semi").select(F.concat(F.lit("="), F.col("fn").cast("string")).alias("fn"), "src", "dst")
    drawn = scratch.save(shapes.select(F.col("shape").alias("fn"), F.inline("arcs")).unionByName(large), "drawn")
    found, locs = _placed(drawn, shapes.select(F.col("shape").alias("fn"), F.explode("starts").alias("entry")), scratch)
    names = named.select("fn", "shape")
    own = named.where("shape NOT LIKE '=%'").select("fn", "shape", F.explode(F.array_distinct(F.concat("starts", F.flatten(F.transform(F.coalesce("arcs", F.array().cast("array<struct<src:bigint,dst:bigint>>")), lambda e: F.array(e["src"], e["dst"])))))).alias("loc"))
    other = edges.join(big, "fn", "left_semi").select("fn", F.explode(F.array("src", "dst")).alias("loc")).unionByName(entries.join(big, "fn", "left_semi").select("fn", F.col("entry").alias("loc"))).distinct()
    nodes = shuffled(own.unionByName(other.select("fn", F.concat(F.lit("="), F.col("fn").cast("string")).alias("shape"), "loc")))
    placed = scratch.save(nodes.join(locs.withColumnRenamed("fn", "shape"), ["shape", "loc"]).select("fn", *(c for c in locs.columns if c != "fn")), "placed-locs")
    rows = shuffled(edges.join(names, "fn")).join(found.withColumnRenamed("fn", "shape"), ["shape", "src", "dst"]).drop("shape")
    return CellGraph(scratch.save(rows, "placed-edges"), placed, entries)


def _placed(edges: DataFrame, entries: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Where ``edges(fn, src, dst)`` and locations that ``entries(fn, entry)`` reach lie in loops, and how many edges lead to them."""
    locs = scratch.save(dominators.reachable(edges, entries), "reachable")
    edges = scratch.save(edges.join(locs.withColumnRenamed("loc", "src"), ["fn", "src"], "left_semi"), "edges")
    back = scratch.save(dominators.back_edges(edges, entries, locs), "back")
    around = graph.containing_heads(edges.select(F.col("fn").alias("fn_id"), "src", "dst"), back.withColumnRenamed("fn", "fn_id")).withColumnRenamed("fn_id", "fn")
    # Outermost first: the loop around more locations.
    sizes = scratch.save(around.select("fn", "loc", F.explode("heads").alias("head")), "around")
    wide = sizes.groupBy("fn", "head").agg(F.count("*").alias("n"))
    nests = sizes.join(wide, ["fn", "head"]).groupBy("fn", "loc").agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), F.col("head").cast("long").alias("head")))).alias("l"))
    heads = back.select("fn", F.col("dst").alias("loc")).distinct().withColumn("is_head", F.lit(True))
    forward = shuffled(edges.join(back, ["fn", "src", "dst"], "left_anti"))
    n_in = forward.groupBy("fn", F.col("dst").alias("loc")).agg(F.count("*").alias("n_in"))
    # Entry states are an input of their own.
    n_in = shuffled(n_in.join(entries.select("fn", F.col("entry").alias("loc"), F.lit(1).alias("one")), ["fn", "loc"], "full_outer")).select("fn", "loc", (F.coalesce("n_in", F.lit(0)) + F.coalesce("one", F.lit(0))).cast("int").alias("n_in"))
    none = F.array().cast(_LOCS)
    placed = locs.join(nests, ["fn", "loc"], "left").join(heads, ["fn", "loc"], "left").join(n_in, ["fn", "loc"], "left")
    placed = scratch.save(placed.select("fn", F.col("loc").cast("long").alias("loc"), F.coalesce(F.col("l.head"), none).alias("nest"), F.coalesce("is_head", F.lit(False)).alias("is_head"), F.coalesce("n_in", F.lit(0)).alias("n_in")), "locs")
    side = lambda x: placed.select("fn", F.col("loc").alias(x), F.col("nest").alias(f"{x}_nest"), F.col("is_head").alias(f"{x}_head"), F.col("n_in").alias(f"{x}_in"))
    numbered = graph.edge_ordinals(forward.select("fn", "src", "dst"), ["fn", "dst"], ["src"]).withColumnRenamed("idx", "i")
    loops_back = back.groupBy("fn", "dst").agg(F.count("*").cast("int").alias("n_back"))
    rows = edges.join(back.withColumn("is_back", F.lit(True)), ["fn", "src", "dst"], "left").join(numbered, ["fn", "src", "dst"], "left").join(loops_back, ["fn", "dst"], "left")
    rows = rows.join(side("src").drop("src_in"), ["fn", "src"]).join(side("dst"), ["fn", "dst"]).withColumns({"is_back": F.coalesce("is_back", F.lit(False)), "i": F.coalesce("i", F.lit(-1))})
    from_iter = F.col("src_head") & (F.array_contains("dst_nest", F.col("src")) | (F.col("src") == F.col("dst")))
    own = F.concat("src_nest", F.when(from_iter, F.array("src")).otherwise(none))
    stays = F.size("dst_nest") + F.col("is_back").cast("int")
    rows = rows.withColumns({"from_iter": from_iter, "is_join": F.col("dst_in") > 1, "stays": stays, "left": F.when(F.size(own) > stays, F.slice(own, stays + 1, F.size(own) - stays)).otherwise(none)})
    return scratch.save(rows.drop("src_head"), "shaped-edges"), placed


def transfer_inputs(cells: DataFrame, comps: DataFrame) -> DataFrame:
    """``(fn, cell, stmt, state, error)``: the statement and the state that each transfer reads.

    A cell that has not exactly one of either is malformed: it is a row with its ``error`` and without inputs.
    """
    kinds = shuffled(cells.select("fn", F.col("cell").alias("src"), F.col("kind").alias("of")))
    inputs = comps.where("kind = 'transfer'").join(kinds, ["fn", "src"], "left")
    side = lambda k: F.when(F.col("of") == k, F.col("src"))
    met = inputs.groupBy("fn", F.col("dst").alias("cell")).agg(F.count_if(F.col("of") == "stmt").alias("stmts"), F.count_if(F.col("of") == "state").alias("states"), F.count("*").alias("n"), F.min(side("stmt")).alias("stmt"), F.min(side("state")).alias("state"))
    good = (F.col("stmts") == 1) & (F.col("states") == 1) & (F.col("n") == 2)
    text = F.concat(F.col("stmts"), F.lit(" statements, "), F.col("states"), F.lit(" states, "), F.col("n"), F.lit(" inputs"))
    return met.select("fn", "cell", F.when(good, F.col("stmt")).alias("stmt"), F.when(good, F.col("state")).alias("state"), F.when(~good, text).alias("error"))


# --- values --------------------------------------------------------------------


def transfer(op: Column, a: Column, b: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """A statement on a state: add [a, b], set to [a, b], or keep what is at most b or at least a."""
    x, y = Itv(lo, hi), Itv(a, b)
    cases = {"add": x.add(y), "set": y, "below": x.meet(Itv(F.lit(NEG), b)), "above": x.meet(Itv(a, F.lit(POS)))}
    low, high = lo, hi
    for name, case in cases.items():
        low, high = F.when(op == name, case.lo).otherwise(low), F.when(op == name, case.hi).otherwise(high)
    empty = (lo > hi) | (low > high)
    return F.when(empty, F.lit(POS)).otherwise(low), F.when(empty, F.lit(NEG)).otherwise(high)


def _widened(lo: Column, hi: Column, new_lo: Column, new_hi: Column) -> tuple[Column, Column]:
    w = Itv(lo, hi).widen(Itv(new_lo, new_hi))
    none, still = lo > hi, new_lo > new_hi
    return F.when(none, new_lo).when(still, lo).otherwise(w.lo), F.when(none, new_hi).when(still, hi).otherwise(w.hi)


@dataclass
class Values:
    """``cells(fn, loc, role, slot, ctx, lo, hi, sends)`` and ``ended(fn, head, ctx, at)``: loops by iteration of convergence.

    ``ctx`` numbers the iterations of the loops around a cell, of an iterate its own too.
    """

    cells: DataFrame
    ended: DataFrame
    rounds: int

    def at_locations(self, locs: DataFrame) -> DataFrame:
        """``(fn, loc, lo, hi)`` of the converged instance of each location, and ``iterations`` of heads."""
        rows = self.cells.where("role = 'at'").join(locs.select("fn", "loc", "nest"), ["fn", "loc"])
        parts = rows.select("fn", "loc", "lo", "hi", "ctx", "nest", F.posexplode_outer("nest").alias("d", "head"))
        outer = F.when(F.col("d").isNotNull(), F.slice("ctx", 1, F.col("d"))).alias("outer")
        ended = self.ended.withColumnRenamed("ctx", "outer")
        held = parts.select("*", outer).join(ended, ["fn", "head", "outer"], "left")
        fits = F.col("d").isNull() | F.coalesce(F.try_element_at("ctx", F.col("d") + 1) == F.col("at"), F.lit(False))
        final = held.groupBy("fn", "loc", "ctx").agg(F.bool_and(fits).alias("ok"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).where("ok")
        own = self.ended.select("fn", F.col("head").alias("loc"), "ctx", (F.col("at") + 1).alias("iterations"))
        return final.join(own, ["fn", "loc", "ctx"], "left").select("fn", "loc", "lo", "hi", "iterations")


_ROW = ["tag", "fn", "loc", "role", "slot", "ctx", "lo", "hi", "sends", "n", "head", "left"]


def _rows(df: DataFrame, tag: str, **columns: Column) -> DataFrame:
    """Rows of a round, in one schema for all kinds."""
    kinds = {"loc": "long", "role": "string", "slot": "int", "ctx": _INTS, "lo": "double", "hi": "double", "sends": "boolean", "n": "int", "head": "boolean", "left": _LOCS}
    own = {c: (columns[c] if c in columns else F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in kinds.items()}
    return df.select(F.lit(tag).alias("tag"), F.col("fn"), *(v.alias(c) for c, v in own.items()))


def evaluate(g: CellGraph, wanted: DataFrame | None = None, kept: Values | None = None, answers: DataFrame | None = None) -> Values:
    """Values of all cells, or of those that ``wanted(fn, loc)`` depend on.

    ``kept``: cells that are known already; only what they lack is computed. ``answers(callee, in_lo, in_hi,
    lo, hi)`` are what edges with op call and a ``callee`` make of a state (of any state, where they are on a ``circle``);
    what has no answer is not sent.
    """
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "values", spread=True)
    edges, entries = g.edges, g.entries
    if wanted is not None:
        node = lambda c: F.struct(F.col("fn"), F.col(c).cast("long").alias("loc"))
        back = edges.select(node("dst").alias("src"), node("src").alias("dst"))
        # A location within a loop depends on its whole loop: the head asks for the tails.
        around = edges.select("fn", "dst", F.explode("dst_nest").alias("h")).select(F.struct(F.col("fn"), F.col("dst").cast("long").alias("loc")).alias("src"), F.struct(F.col("fn"), F.col("h").alias("loc")).alias("dst"))
        cone = scratch.save(graph.reach(back.union(around).distinct(), wanted.select(F.lit(0).alias("origin"), node("loc").alias("node"))).select("node.fn", "node.loc"), "cone")
        edges = scratch.save(edges.join(cone.withColumnRenamed("loc", "dst"), ["fn", "dst"], "left_semi"), "demanded")
        entries = entries.join(cone.select("fn").distinct(), "fn", "left_semi")
    flow = scratch.save(edges.select("fn", F.col("src").alias("loc"), "dst", F.when(F.col("from_iter"), "iter").otherwise("at").alias("role"), "op", "a", "b", "i", "is_back", "is_join", "dst_head", "left", "stays", F.when(F.col("is_back"), F.col("n_back")).otherwise(F.col("dst_in")).alias("n"), *(["callee", "circle"] if answers is not None else [])), "flow")

    start = entries.join(g.locs.withColumnRenamed("loc", "entry"), ["fn", "entry"]).select("fn", F.col("entry").cast("long").alias("loc"), "lo", "hi", "is_head", "n_in")
    if kept is None:
        joined = F.col("n_in") > 1
        alone = start.where(~joined).select("fn", "loc", F.when(F.col("is_head"), "iter").otherwise("at").alias("role"), F.when(F.col("is_head"), F.array(F.lit(0))).otherwise(F.array().cast(_INTS)).alias("ctx"), "lo", "hi")
        waits = start.where(joined).select("fn", "loc", F.lit("pre").alias("role"), F.array().cast(_INTS).alias("ctx"), "lo", "hi", (F.col("n_in") - 1).alias("n"), F.col("is_head").alias("head"))
        first = _rows(alone, "value", sends=F.lit(True), slot=F.lit(-1)).unionByName(_rows(waits, "waits")).unionByName(_rows(alone.where("role = 'iter'"), "loop"))
        ended = spark.createDataFrame([], _ended_schema(g))
    else:
        first, ended = _resumed(flow, start, kept, answers), kept.ended
    state, parts, ends, known, turn = scratch.save(first, "round-0"), [], [ended], ended, 0
    if answers is None:
        big = scratch.save(flow.groupBy("fn").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL).select("fn"), "big")
        small = lambda df: shuffled(df.join(big, "fn", "left_anti"))
        parts, found = _in_rows(small(state), small(flow), small(ended), scratch)
        ends += found
        state, flow, known = (shuffled(df.join(big, "fn", "left_semi")) for df in (state, flow, ended))
    if answers is not None or not big.isEmpty():
        tables, found, turn = _by_rounds(state, flow, known, answers, scratch)
        parts, ends = parts + tables, ends + found
    cells = graph.rows_of(p.select("fn", "loc", "role", "slot", "ctx", "lo", "hi", "sends") for p in parts)
    if kept is not None:
        cells = kept.cells.unionByName(cells.join(kept.cells, ["fn", "loc", "role", "slot", "ctx"], "left_anti"))
    return Values(cells, graph.rows_of(iter(ends)), turn)


def _by_rounds(state: DataFrame, flow: DataFrame, ended: DataFrame, answers: DataFrame | None, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Rows of values and of newly ended loops of programs of any size, a table for each round, and the number of rounds."""
    parts, ends = [state.where("tag = 'value'")], []
    for turn in itertools.count(1):
        state = scratch.save(_round(state, flow, graph.rows_of(iter([ended, *ends])), answers), f"round-{turn}")
        if not _moves(state):
            return parts, ends, turn
        parts.append(state.where("tag = 'value'"))
        ends.append(state.where("tag = 'ended'").select("fn", F.col("loc").alias("head"), "ctx", F.col("n").alias("at")))
        if len(parts) > 16:  # keep the plans short
            parts = [scratch.save(graph.rows_of(iter(parts)), f"values-{turn}")]
            ends = [scratch.save(graph.rows_of(iter(ends)), f"ended-{turn}")]


def _ended_schema(g: CellGraph) -> str:
    return f"fn {g.edges.schema['fn'].dataType.simpleString()}, head long, ctx {_INTS}, at int"


def _moves(state: DataFrame) -> bool:
    """Whether a round has filled a cell or ended a loop; barriers alone do not open themselves."""
    return not state.where("tag IN ('value', 'ended', 'opened')").isEmpty()


def _sent(sending: DataFrame, flow: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """What cells send along their edges: ``(fn, loc, i, is_back, is_join, dst_head, n, ctx, lo, hi, left, stays)``."""
    moved = sending.select("fn", "loc", "role", "ctx", "lo", "hi").join(flow, ["fn", "loc", "role"])
    lo, hi = transfer(F.col("op"), F.col("a"), F.col("b"), F.col("lo"), F.col("hi"))
    if answers is not None:
        told = answers.select("callee", "in_lo", "in_hi", F.struct("lo", "hi").alias("told"))
        asked = {"in_lo": F.when(F.col("circle"), F.lit(NEG)).otherwise(F.col("lo")), "in_hi": F.when(F.col("circle"), F.lit(POS)).otherwise(F.col("hi"))}
        moved = moved.withColumns(asked).join(told, ["callee", "in_lo", "in_hi"], "left")
        asks = (F.col("op") == "call") & (F.col("lo") <= F.col("hi"))
        moved = moved.where(~asks | F.col("told").isNotNull())
        lo, hi = F.when(asks, F.col("told.lo")).otherwise(lo), F.when(asks, F.col("told.hi")).otherwise(hi)
    return moved.select("fn", F.col("dst").cast("long").alias("loc"), "i", "is_back", "is_join", "dst_head", "n", "ctx", lo.alias("lo"), hi.alias("hi"), "left")


def _as_rows(sent: DataFrame, tag: str) -> DataFrame:
    role = F.when(F.col("is_back"), "prewiden").when(F.col("is_join"), "pre").otherwise("at")
    return _rows(sent, tag, role=role, slot=F.col("i"), head=F.col("dst_head"))


def _round(state: DataFrame, flow: DataFrame, ended: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """The rows of the next round: filled cells, inputs that wait for others, what waits at barriers, open loops and ended ones.

    One join with the edges, one with ended loops and one aggregation, whatever becomes of a row.
    """
    sent = _as_rows(_sent(state.where("tag = 'value' AND sends"), flow, answers), "sent").unionByName(state.where("tag IN ('sent', 'held')"))
    # Barriers: the innermost loop still to be left must have ended, in this iteration.
    outer = F.expr("slice(ctx, 1, size(ctx) - 1)")
    done = ended.select("fn", F.col("head").alias("h"), F.col("ctx").alias("outer"), "at")
    leaves = F.size("left") > 0
    gate = sent.withColumns({"h": F.try_element_at("left", F.lit(-1)), "outer": F.when(leaves, outer)}).join(done, ["fn", "h", "outer"], "left")
    opens = leaves & F.coalesce(F.try_element_at("ctx", F.lit(-1)) == F.col("at"), F.lit(False))
    kept = gate.where(~leaves | F.col("at").isNull() | opens).withColumns({"ctx": F.when(opens, F.col("outer")).otherwise(F.col("ctx")), "left": F.when(opens, F.expr("slice(left, 1, size(left) - 1)")).otherwise(F.col("left")), "opened": opens})
    barred = F.size("left") > 0
    inputs = kept.select("fn", "loc", "role", "ctx", F.when(barred, F.col("left")).alias("left"), F.when(barred, F.col("slot")).alias("gate"), "slot", "lo", "hi", F.col("n").alias("want"), "head", "opened", F.lit("in").alias("what"), F.lit(None).cast("int").alias("missing"))
    stored = state.where("tag IN ('waits', 'loop')")
    other = stored.select(
        "fn", "loc", F.when(F.col("tag") == "loop", "prewiden").otherwise(F.col("role")).alias("role"), "ctx", F.lit(None).cast(_LOCS).alias("left"), F.lit(None).cast("int").alias("gate"), F.lit(None).cast("int").alias("slot"),
        "lo", "hi", F.lit(None).cast("int").alias("want"), "head", F.lit(False).alias("opened"), F.col("tag").alias("what"), F.when(F.col("tag") == "waits", F.col("n")).alias("missing"),
    )
    is_in, is_loop = F.col("what") == "in", F.col("what") == "loop"
    met = inputs.unionByName(other).groupBy("fn", "loc", "role", "ctx", "left", "gate").agg(
        F.min(F.when(~is_loop, F.col("lo"))).alias("lo"), F.max(F.when(~is_loop, F.col("hi"))).alias("hi"), F.count_if(is_in).alias("new"), F.min("missing").alias("missing"), F.max("want").alias("want"), F.max("head").alias("head"),
        F.max(F.when(is_loop, F.struct("lo", "hi"))).alias("loop"), F.max("opened").alias("opened"),
        F.collect_list(F.when(is_in & F.col("left").isNull() & (F.col("role") != "at"), F.struct("slot", "lo", "hi"))).alias("cells"),  # a cell has as many as edges lead to it
    )

    return met.select("fn", "loc", F.inline(_outcome(F.col))).select(_ROW)


def _outcome(of: Callable[[str], Column]) -> Column:
    """What becomes of the inputs that have met at one cell or barrier, ``of`` their columns: the rows of the next round, without program and location."""
    lo, hi, ctx, head, loop = (of(c) for c in ("lo", "hi", "ctx", "head", "loop"))
    lacks = (F.coalesce(of("missing"), of("want")) - of("new")).cast("int")
    at_gate, widens, joins = of("left").isNotNull(), of("role") == "prewiden", of("role") == "pre"
    full = ~at_gate & (of("new") > 0) & ((of("role") == "at") | (lacks == 0))
    low, high = _widened(loop["lo"], loop["hi"], lo, hi)
    k, around = F.try_element_at(ctx, F.lit(-1)), F.slice(ctx, F.lit(1), F.size(ctx) - 1)
    same = (low == loop["lo"]) & (high == loop["hi"])

    def row(when: Column, tag: str, **columns: Column) -> Column:
        own = {"tag": F.lit(tag), "role": of("role"), "slot": F.lit(-1), "ctx": ctx, "lo": lo, "hi": hi, "sends": F.lit(False), "n": F.lit(None), "head": head, "left": F.lit(None)} | columns
        kinds = {"slot": "int", "ctx": _INTS, "lo": "double", "hi": "double", "n": "int", "left": _LOCS}
        return F.when(when, F.struct(*(c.cast(kinds[n]).alias(n) if n in kinds else c.alias(n) for n, c in own.items())))

    begins, again = F.concat(ctx, F.array(F.lit(0))), F.concat(around, F.array(k + 1))
    yes, none = F.lit(True), F.array().cast(_LOCS)
    out = [
        row(full & ~widens & ~head, "value", role=F.lit("at"), sends=yes, left=none),
        row(full & ~widens & head, "value", role=F.lit("iter"), ctx=begins, sends=yes, left=none),
        row(full & ~widens & head, "loop", role=F.lit("iter"), ctx=begins),
        row(full & widens, "value", role=F.lit("iter"), ctx=again, lo=low, hi=high, sends=~same),
        row(full & widens & same, "value", role=F.lit("at"), ctx=around, lo=low, hi=high, sends=yes),
        row(full & widens & same, "ended", ctx=around, n=k),
        row(full & widens & ~same, "loop", role=F.lit("iter"), ctx=again, lo=low, hi=high),
        row(~full & widens & ~at_gate & loop.isNotNull(), "loop", role=F.lit("iter"), lo=loop["lo"], hi=loop["hi"]),
        row(~at_gate & (joins | widens) & (lacks > 0), "waits", n=lacks),
        row(at_gate, "held", slot=of("gate"), n=of("want"), left=of("left")),
        row(at_gate & of("opened"), "opened"),
    ]
    filled = F.transform(of("cells"), lambda c: F.struct(
        F.lit("value").alias("tag"), of("role").alias("role"), c["slot"].alias("slot"), ctx.alias("ctx"), c["lo"].alias("lo"), c["hi"].alias("hi"), F.lit(False).alias("sends"), F.lit(None).cast("int").alias("n"), head.alias("head"), none.alias("left"),
    ))
    return F.concat(F.filter(F.array(*out), lambda r: r.isNotNull()), filled)


# --- values of small programs, within a row ----------------------------------------

#: Edges up to which a program's values are computed within a row of its own, and the rounds of one pass over such rows.
LOCAL, ROUNDS = 64, 32

_FIELDS = _ROW[:1] + _ROW[2:]
_STATES = f"array<struct<tag:string,loc:bigint,role:string,slot:int,ctx:{_INTS},lo:double,hi:double,sends:boolean,n:int,head:boolean,left:{_LOCS}>>"
_KEY = ["loc", "role", "ctx", "left", "gate"]
_INPUT = ["key", "slot", "lo", "hi", "want", "head", "opened", "what", "missing"]
_ENDS = f"array<struct<head:bigint,ctx:{_INTS},at:int>>"
_KEPT = ["state", "ends", "values", "live"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _named(names: list[str], *columns: Column) -> Column:
    """A struct; casts would go through all its arrays in every round."""
    return F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True)))


def _row_round(state: Column, flow: Column, ended: Column) -> Column:
    """``_round`` for one program, whose ``state``, edges and ended loops are arrays of a row: no join, no shuffle."""
    null, number = F.lit(None), F.lit(None).cast("int")

    def sent(s: Column, f: Column) -> Column:
        lo, hi = transfer(f["op"], f["a"], f["b"], s["lo"], s["hi"])
        role = F.when(f["is_back"], "prewiden").when(f["is_join"], "pre").otherwise("at")
        return _named(_FIELDS, F.lit("sent"), f["dst"], role, f["i"], s["ctx"], lo, hi, null.cast("boolean"), f["n"], f["dst_head"], f["left"])

    def gated(s: Column) -> Column:
        leaves, head, ctx = F.size(s["left"]) > 0, F.try_element_at(s["left"], F.lit(-1)), s["ctx"]
        outer = F.slice(ctx, F.lit(1), F.size(ctx) - 1)
        at = F.when(leaves, F.get(F.transform(F.filter(ended, lambda e: (e["head"] == head) & (e["ctx"] == outer)), lambda e: e["at"]), F.lit(0)))

        def through(at: Column) -> Column:
            opens = leaves & F.coalesce(F.try_element_at(ctx, F.lit(-1)) == at, F.lit(False))
            left = F.when(opens, F.slice(s["left"], F.lit(1), F.size(s["left"]) - 1)).otherwise(s["left"])
            barred = F.size(left) > 0
            key = _named(_KEY, s["loc"], s["role"], F.when(opens, outer).otherwise(ctx), F.when(barred, left), F.when(barred, s["slot"]))
            return F.when(~leaves | at.isNull() | opens, _named(_INPUT, key, s["slot"], s["lo"], s["hi"], s["n"], s["head"], opens, F.lit("in"), number))

        return _let(at, through)

    def stored(s: Column) -> Column:
        key = _named(_KEY, s["loc"], F.when(s["tag"] == "loop", "prewiden").otherwise(s["role"]), s["ctx"], null.cast(_LOCS), number)
        return _named(_INPUT, key, number, s["lo"], s["hi"], number, s["head"], F.lit(False), s["tag"], F.when(s["tag"] == "waits", s["n"]))

    def met(k: Column, own: Column) -> Column:
        new = F.filter(own, lambda r: r["what"] == "in")
        given = F.filter(own, lambda r: r["what"] != "loop")
        each = lambda rows, c: F.transform(rows, lambda r: r[c])
        fills = F.filter(new, lambda r: k["left"].isNull() & (k["role"] != "at"))
        return F.struct(
            *(k[c].alias(c) for c in ("loc", "role", "ctx", "left", "gate")), F.array_min(each(given, "lo")).alias("lo"), F.array_max(each(given, "hi")).alias("hi"), F.size(new).alias("new"),
            F.array_min(each(own, "missing")).alias("missing"), F.array_max(each(own, "want")).alias("want"), F.array_max(each(own, "head")).alias("head"), F.array_max(each(own, "opened")).alias("opened"),
            F.array_max(F.transform(F.filter(own, lambda r: r["what"] == "loop"), lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))).alias("loop"),
            F.transform(fills, lambda r: F.struct(r["slot"].alias("slot"), r["lo"].alias("lo"), r["hi"].alias("hi"))).alias("cells"),
        )

    def following(m: Column) -> Column:
        return F.transform(_outcome(lambda c: m[c]), lambda r: _named(_FIELDS, *(m[c] if c == "loc" else r[c] for c in _FIELDS)))

    sending = F.filter(state, lambda s: (s["tag"] == "value") & s["sends"])
    moved = F.flatten(F.transform(sending, lambda s: F.transform(F.filter(flow, lambda f: (f["loc"] == s["loc"]) & (f["role"] == s["role"])), lambda f: sent(s, f))))
    waiting = F.filter(state, lambda s: s["tag"].isin("sent", "held"))
    inputs = F.filter(F.transform(F.concat(moved, waiting), gated), lambda r: r.isNotNull())
    other = F.transform(F.filter(state, lambda s: s["tag"].isin("waits", "loop")), stored)
    by_key = lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda r: r["key"])), lambda k: _let(F.filter(rows, lambda r: r["key"] == k), lambda own: met(k, own)))
    return F.flatten(F.transform(_let(F.concat(inputs, other), by_key), following))


def _in_rows(first: DataFrame, flow: DataFrame, ended: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows of values and of newly ended loops of programs that fit a row: a pass runs ``ROUNDS`` rounds, those that still move have another."""
    listed = lambda df, name, columns: shuffled(df.select("fn", F.struct(*columns).alias("row")).repartition("fn").groupBy("fn").agg(F.collect_list("row").alias(name)))
    edges = listed(flow, "flow", [c for c in flow.columns if c != "fn"])
    rows = listed(first, "state", _FIELDS).join(listed(ended, "ended", ["head", "ctx", "at"]), "fn", "left").withColumn("values", F.filter("state", lambda r: r["tag"] == "value"))
    none = F.array().cast(edges.schema["flow"].dataType)
    values, ends = [], []
    for turn in itertools.count(1):
        rows = rows.join(edges, "fn", "left").select("fn", "state", F.coalesce("ended", F.array().cast(_ENDS)).cast(_ENDS).alias("ended"), "values", F.coalesce("flow", none).alias("flow"))
        start = _named(_KEPT, F.col("state").cast(_STATES), F.array().cast(_ENDS), F.col("values").cast(_STATES), F.lit(True))

        def play(acc: Column, _: Column) -> Column:
            def added(new: Column) -> Column:
                ends = F.transform(F.filter(new, lambda r: r["tag"] == "ended"), lambda r: _named(["head", "ctx", "at"], r["loc"], r["ctx"], r["n"]))
                return _named(_KEPT, new, F.concat(acc["ends"], ends), F.concat(acc["values"], F.filter(new, lambda r: r["tag"] == "value")), F.exists(new, lambda r: r["tag"].isin("value", "ended", "opened")))

            return F.when(acc["live"], _let(_row_round(acc["state"], F.col("flow"), F.concat("ended", acc["ends"])), added)).otherwise(acc)

        held = scratch.save(rows.select("fn", "ended", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, play).alias("v")), f"pass-{turn}")
        values.append(held.select("fn", F.inline("v.values")))
        ends.append(held.select("fn", F.inline("v.ends")))
        rest = held.where("v.live")
        if rest.isEmpty():
            return values, ends
        rows = rest.select("fn", "v.state", F.concat("ended", "v.ends").alias("ended"), F.array().cast(_STATES).alias("values"))


# --- edits ---------------------------------------------------------------------


def dirtied(g: CellGraph, values: Values, changed: DataFrame) -> Values:
    """What ``changed(fn, src, dst)`` edges leave of the values: cells that do not depend on their statements.

    The cone goes from the cells that the edges lead to; cells without a value end it. A dirtied
    loop keeps its iterate 0 unless that is dirty too: later iterates, all instances of later iterations
    and the loop's end go.
    """
    scratch = Scratch(g.edges.sparkSession, "dirtied", spread=True)
    touched = scratch.save(changed.select("fn").distinct(), "touched")
    g = CellGraph(*(shuffled(df.join(touched, "fn", "left_semi")) for df in (g.edges, g.locs, g.entries)))
    cells = g.cells.where("kind = 'state'")
    own = values.cells.join(touched, "fn", "left_semi")
    first = F.when(F.col("role") == "iter", F.least(F.try_element_at("ctx", F.lit(-1)), F.lit(1))).otherwise(F.col("slot"))
    filled = own.select("fn", "loc", "role", first.cast("int").alias("slot")).distinct()
    cells = scratch.save(cells.join(filled, ["fn", "loc", "role", "slot"], "left_semi"), "filled")
    node = lambda c: F.struct(F.col("fn"), F.col(c).alias("cell"))
    comps = g.comps.join(cells.select("fn", F.col("cell").alias("dst")), ["fn", "dst"], "left_semi").select(node("src").alias("src"), node("dst").alias("dst"))
    stmts = g.edges.join(changed.select("fn", "src", "dst").distinct(), ["fn", "src", "dst"], "left_semi").select("fn", _stmt().alias("cell"))
    reached = graph.reach(comps, stmts.select(F.lit(0).alias("origin"), node("cell").alias("node"))).select("node.fn", "node.cell")
    dirty = scratch.save(cells.join(reached, ["fn", "cell"], "left_semi").select("fn", "loc", "role", "slot"), "dirty")
    rings = dirty.where("role = 'iter' AND slot = 1").groupBy("fn").agg(F.collect_set("loc").alias("rings"))  # loops of one program
    placed = own.withColumn("first", first.cast("int")).join(g.locs.select("fn", "loc", "nest"), ["fn", "loc"]).join(rings, "fn", "left")
    loops = F.when(F.col("role").isin("iter", "prewiden"), F.concat("nest", F.array("loc"))).otherwise(F.col("nest"))
    later = F.exists(F.arrays_zip(loops.alias("l"), F.col("ctx").alias("k")), lambda p: (p["k"] >= 1) & F.array_contains(F.coalesce("rings", F.array().cast(_LOCS)), p["l"]))
    placed = placed.where(~later).drop("nest", "rings")
    clean = placed.join(dirty.withColumnRenamed("slot", "first"), ["fn", "loc", "role", "first"], "left_anti").drop("first")
    clean = scratch.save(clean.select(values.cells.columns), "clean")
    fixes = clean.where("role = 'at'").select("fn", F.col("loc").alias("head"), "ctx")
    ended = scratch.save(values.ended.join(touched, "fn", "left_semi").join(fixes, ["fn", "head", "ctx"], "left_semi"), "ended")
    return Values(clean, ended, 0)


def _resumed(flow: DataFrame, start: DataFrame, kept: Values, answers: DataFrame | None) -> DataFrame:
    """The first round over kept values: they send again, but only to cells that have none, and loops without an end are open at their last iterate."""
    have = kept.cells.select("fn", "loc", "role", "ctx").where("role IN ('at', 'iter')")
    sent = _as_rows(_sent(kept.cells.where("sends"), flow, answers), "sent")
    begins = F.array(F.lit(0))
    # The cell that an input ends in: a head's iterate 0 or the next one, or the location itself.
    final = F.expr("slice(ctx, 1, size(ctx) - size(left))")
    into = F.when(F.col("role") == "prewiden", F.concat(F.expr("slice(ctx, 1, size(ctx) - size(left) - 1)"), F.array(F.try_element_at(final, F.lit(-1)) + 1))).when(F.col("head"), F.concat(final, begins)).otherwise(final)
    lacking = sent.withColumns({"to": into, "what": F.when((F.col("role") == "prewiden") | F.col("head"), "iter").otherwise("at")})
    lacking = lacking.join(have.select("fn", "loc", F.col("role").alias("what"), F.col("ctx").alias("to")), ["fn", "loc", "what", "to"], "left_anti").select(_ROW)
    roots = start.select("fn", "loc", F.when(F.col("is_head"), "iter").otherwise("at").alias("role"), F.when(F.col("is_head"), begins).otherwise(F.array().cast(_INTS)).alias("ctx"), "lo", "hi", "n_in", "is_head")
    fresh = roots.join(have, ["fn", "loc", "role", "ctx"], "left_anti")
    alone = fresh.where("n_in <= 1")
    waits = _rows(fresh.where("n_in > 1"), "waits", role=F.lit("pre"), ctx=F.array().cast(_INTS), n=F.col("n_in") - 1, head=F.col("is_head"))
    iterates = kept.cells.where("role = 'iter'").withColumns({"k": F.try_element_at("ctx", F.lit(-1)), "outer": F.expr("slice(ctx, 1, size(ctx) - 1)")})
    last = iterates.groupBy("fn", "loc", "outer").agg(F.max_by(F.struct("ctx", "lo", "hi"), "k").alias("v"))
    ended = kept.ended.select("fn", F.col("head").alias("loc"), F.col("ctx").alias("outer"))
    open_loops = last.join(ended, ["fn", "loc", "outer"], "left_anti").select("fn", "loc", "v.ctx", "v.lo", "v.hi")
    begun = _rows(alone, "value", slot=F.lit(-1), sends=F.lit(True))
    return graph.rows_of(iter([lacking, begun, waits, _rows(open_loops, "loop"), begun.where("role = 'iter'").withColumn("tag", F.lit("loop"))]))


# --- states kept in buckets ------------------------------------------------------


class CellStore:
    """Values in two tables of the shared folder, dealt into buckets of programs; an edit rewrites only the buckets that it touches."""

    def __init__(self, g: CellGraph, buckets: int = 64):
        self.graph, self.buckets = g, buckets
        self.scratch = Scratch(g.edges.sparkSession, "cell-store", spread=True)
        self.version = 0

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("fn"), F.lit(self.buckets)).cast("int")

    def path(self, name: str) -> str:
        return f"{self.scratch.root}/{name}"

    def write(self, values: Values, buckets: list[int] | None = None) -> None:
        """Write all values, or those of some buckets."""
        for name, df in (("cells", values.cells), ("ended", values.ended)):
            rows = df.withColumn("bucket", self._bucket()).withColumn("version", F.lit(self.version))
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(buckets))
            writer = rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
            writer.parquet(self.path(name))

    def read(self, buckets: list[int] | None = None) -> Values:
        fn = self.graph.edges.schema["fn"].dataType.simpleString()
        spark = self.graph.edges.sparkSession
        schemas = {"cells": f"fn {fn}, loc long, role string, slot int, ctx {_INTS}, lo double, hi double, sends boolean, version int, bucket int", "ended": f"fn {fn}, head long, ctx {_INTS}, at int, version int, bucket int"}
        found = {n: spark.read.schema(s).parquet(self.path(n)) for n, s in schemas.items()}
        if buckets is not None:
            found = {n: df.where(F.col("bucket").isin(buckets)) for n, df in found.items()}
        return Values(shuffled(found["cells"].drop("bucket", "version")), shuffled(found["ended"].drop("bucket", "version")), 0)

    def fill(self) -> None:
        self.write(evaluate(self.graph))

    def edit(self, changes: DataFrame) -> list[int]:
        """New statements ``changes(fn, src, dst, op, a, b)`` of edges; returns the buckets that were rewritten, numbers below ``buckets``."""
        g, keys = self.graph, ["fn", "src", "dst"]
        self.version += 1
        changes = self.scratch.save(changes.select(*keys, "op", "a", "b"), f"changes-{self.version}")
        new = changes.select(*keys, F.struct("op", "a", "b").alias("new"))
        touched = sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())
        if not touched:
            return []
        edited = g.edges.join(new, keys, "left").withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("op", "a", "b")}).drop("new")
        self.graph = CellGraph(self.scratch.save(edited, f"edges-{self.version}"), g.locs, g.entries)
        before = self.read(touched)
        clean = dirtied(g, before, changes)
        fns = self.scratch.save(changes.select("fn").distinct(), f"programs-{self.version}")
        of = lambda df: shuffled(df.join(fns, "fn", "left_semi"))
        part = CellGraph(of(self.graph.edges), of(g.locs), of(g.entries))
        fresh = evaluate(part, kept=clean)
        rest = Values(before.cells.join(fns, "fn", "left_anti"), before.ended.join(fns, "fn", "left_anti"), 0)
        merged = Values(self.scratch.save(rest.cells.unionByName(fresh.cells.select(rest.cells.columns)), f"cells-{self.version}"), self.scratch.save(rest.ended.unionByName(fresh.ended), f"ended-{self.version}"), 0)
        self.write(merged, touched)
        return touched
