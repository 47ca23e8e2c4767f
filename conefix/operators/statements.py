"""Statement trees lowered to control-flow edges as tables, for all methods at once.

``tree(fn, node, parent, ord, role, kind, label, target, parts, calls)`` has a row for each
statement: ``node`` and ``parent`` are strings, the one statement of a method without a parent is its
body, ``ord`` counts the children of a parent from 0. Kinds: ``empty expr local assert return throw break
continue block synchronized if while do for foreach switch try``; all others are reported. Roles of
children: ``then`` and ``else``; ``body``; ``case`` and ``default``, which fall through in order; ``body``,
``resource``, ``catch``, ``catch_all`` and ``finally`` of a try, resources with an ``ord`` of their own.
``label`` names a statement, ``target`` is the label of a break or continue, ``parts`` the number of
declarators, ``calls`` says that an expression, declaration
or return may throw.

What a statement needs is where control goes from it, by way: next, return, throw, break, continue,
and each label. These targets flow down the trees, a round with one join for each level. A finally block, and
the closing of a resource, exists once for each way that leaves what it guards; which ways these are flows
up the trees first. A copy is a suffix of the names of its locations, so nothing is renumbered.

``edges(fn, src, dst, op, node)``: a method starts at ``in``, returns at ``exit`` and throws at ``throw``.
The names of other locations are of no importance. Statements that cannot be reached keep their edges.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.operators import graph
from conefix.session import Scratch, shuffled

SEQUENCES = ("block", "synchronized")
LOOPS = ("while", "do", "for", "foreach")
SIMPLE = ("empty", "expr", "local", "assert", "return", "throw", "break", "continue")
KINDS = (*SIMPLE, *SEQUENCES, *LOOPS, "if", "switch", "try")
COLUMNS = ("fn", "node", "parent", "ord", "role", "kind", "label", "target", "parts", "calls")


def without_resources(tree: DataFrame) -> DataFrame:
    """Resources as nested statements: each is a block of its declaration and a try that closes it finally.

    What catches or ends the whole try stays around them.
    """
    tree = tree.select(*COLUMNS)
    held = tree.where("role = 'resource'").select("fn", "parent", "ord", "node", "calls")
    last = held.groupBy("fn", "parent").agg(F.max("ord").alias("most"))
    i = F.col("ord").cast("string")
    block, guard, close = (F.concat("parent", F.lit(f"~{c}"), i) for c in "btc")
    outer = F.when(F.col("ord") == 0, F.col("parent")).otherwise(F.concat("parent", F.lit("~t"), (F.col("ord") - 1).cast("string")))

    def row(node: Column, parent: Column, at: int, role: str, kind: str, calls: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(node.alias("node"), parent.alias("parent"), F.lit(at).alias("ord"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), none.alias("label"), none.alias("target"), F.lit(1).alias("parts"), calls.alias("calls"))

    no, yes = F.lit(False), F.lit(True)
    made = F.array(row(block, outer, 0, "body", "block", no), row(F.col("node"), block, 0, "body", "local", F.col("calls")), row(guard, block, 1, "body", "try", no), row(close, guard, 1, "finally", "expr", yes))
    nested = held.select("fn", F.inline(made))
    rest = tree.where("role IS DISTINCT FROM 'resource'").join(last, ["fn", "parent"], "left")
    inner = F.when((F.col("role") == "body") & F.col("most").isNotNull(), F.concat("parent", F.lit("~t"), F.col("most").cast("string")))
    return shuffled(rest.withColumn("parent", F.coalesce(inner, "parent")).select(*COLUMNS).unionByName(nested.select(*COLUMNS)))


def _nodes(tree: DataFrame) -> DataFrame:
    """Statements with the next of their parent's children, and what they are made of."""
    behind = tree.where("parent IS NOT NULL").select("fn", "parent", (F.col("ord") - 1).alias("ord"), F.col("node").alias("following"))
    role = lambda *names: F.max(F.when(F.col("role").isin(*names), F.col("node")))
    made = tree.where("parent IS NOT NULL").groupBy("fn", F.col("parent").alias("node")).agg(
        F.min_by("node", "ord").alias("first"), role("then").alias("then"), role("else").alias("other"), role("default").alias("default"), role("finally").alias("final"),
        role("catch", "catch_all").isNotNull().alias("catches"), role("catch_all").isNotNull().alias("catches_all"),
    )
    out = tree.join(behind, ["fn", "parent", "ord"], "left").join(made, ["fn", "node"], "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("calls", "catches", "catches_all")}
    return out.withColumns(flags).withColumn("parts", F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)))


def _way(kind: Column, target: Column) -> Column:
    return F.when(target.isNull(), kind).otherwise(F.concat_ws(":", kind, target))


def ways_out(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(fn, node, ways)`` of each try with a finally block: how control leaves what it guards, besides at its end."""
    guarded = nodes.where("final IS NOT NULL").select("fn").distinct()
    own = shuffled(nodes.join(guarded, "fn", "left_semi"))
    jump = F.when(F.col("kind").isin("break", "continue"), _way(F.col("kind"), F.col("target"))).when(F.col("kind").isin("return", "throw"), F.col("kind"))
    starts = F.array_compact(F.array(jump, F.when(F.col("calls") | (F.col("kind") == "foreach"), F.lit("throw"))))
    parts = [scratch.save(own.select("fn", "node", F.explode(starts).alias("way")).distinct(), "ways-0")]
    up = own.where("parent IS NOT NULL").select("fn", "node", "role", F.col("parent").alias("above"))
    above = own.select("fn", F.col("node").alias("above"), F.col("kind").alias("around"), F.col("label").alias("named"), "catches_all")
    way, loops = F.col("way"), F.col("around").isin(*LOOPS)
    stops = (way == "break") & (loops | (F.col("around") == "switch")) | (way == "continue") & loops | (way == "throw") & F.col("catches_all") & (F.col("role") == "body")
    stops = stops | F.coalesce((way == F.concat(F.lit("break:"), "named")) | (way == F.concat(F.lit("continue:"), "named")), F.lit(False))
    links = scratch.save(up.join(above, ["fn", "above"]), "links")
    for turn in itertools.count(1):
        step = parts[-1].join(links, ["fn", "node"]).where(~stops).select("fn", F.col("above").alias("node"), "way").distinct()
        newest = scratch.save(step.join(graph.rows_of(iter(parts)), ["fn", "node", "way"], "left_anti"), f"ways-{turn}")
        if newest.isEmpty():
            break
        parts.append(newest)
    leaving = graph.rows_of(iter(parts)).join(links, ["fn", "node"]).where((F.col("around") == "try") & (F.col("role") != "finally") & ~stops)
    return leaving.groupBy("fn", F.col("above").alias("node")).agg(F.sort_array(F.collect_set("way")).alias("ways"))


def _put(targets: Column, way: Column, place: Column) -> Column:
    return F.map_concat(F.map_filter(targets, lambda w, _: w != way), F.create_map(way, place))


def _below(above: DataFrame, nodes: DataFrame) -> DataFrame:
    """The children of placed statements, placed."""
    p = above.select(*(F.col(c).alias(f"p_{c}") for c in ("fn", "node", "kind", "label", "final", "catches", "ways", "copy", "at", "targets")))
    both = nodes.join(p, (F.col("fn") == F.col("p_fn")) & (F.col("parent") == F.col("p_node")))
    kind, role, targets, copy = F.col("p_kind"), F.col("role"), F.col("p_targets"), F.col("p_copy")
    name = F.concat("p_node", "p_copy")
    loops, behind = kind.isin(*LOOPS), targets["next"]
    latch = F.concat(name, F.when(kind == "do", F.lit("#c")).otherwise(F.lit("#l")))
    used = F.array_union(F.array(F.lit("next")), F.coalesce("p_ways", F.array().cast("array<string>")))
    # What a finally block guards leaves by a copy of it for each way.
    guarded = F.transform_values(F.map_filter(targets, lambda w, _: F.array_contains(used, w)), lambda w, _: F.concat(F.col("p_final"), copy, F.lit("/"), w))
    base = F.when((kind == "try") & F.col("p_final").isNotNull() & (role != "finally"), guarded).otherwise(targets)
    after = F.when(kind.isin(*SEQUENCES, "switch") & F.col("following").isNotNull(), F.concat("following", copy)).when(loops, latch).otherwise(base["next"])
    out = _put(base, F.lit("next"), after)
    out = F.when(loops | (kind == "switch"), _put(out, F.lit("break"), behind)).otherwise(out)
    both = both.withColumn("targets", out)
    out = F.col("targets")
    both = both.withColumn("targets", F.when(loops, _put(out, F.lit("continue"), latch)).when((kind == "try") & (role == "body") & F.col("p_catches"), _put(out, F.lit("throw"), F.concat(name, F.lit("#d")))).otherwise(out))
    named = F.col("p_label").isNotNull()
    # The label of a try with a finally block names what is behind that block.
    both = both.withColumn("targets", F.when(named, _put(out, F.concat(F.lit("break:"), "p_label"), base["next"])).otherwise(out))
    both = both.withColumn("targets", F.when(named & loops, _put(out, F.concat(F.lit("continue:"), "p_label"), latch)).otherwise(out))
    ways = F.when((kind == "try") & (role == "finally"), F.filter(used, lambda w: targets[w].isNotNull())).otherwise(F.array(F.lit(None).cast("string")))
    both = both.withColumn("way", F.explode(ways)).withColumn("copy", F.when(F.col("way").isNull(), copy).otherwise(F.concat(copy, F.lit("/"), "way")))
    shares = kind.isin(*SEQUENCES) & (F.col("ord") == 0) | (kind == "try") & (role == "body")
    placed = {"at": F.when(shares, F.col("p_at")).otherwise(F.concat("node", "copy")), "targets": F.when(F.col("way").isNotNull(), _put(out, F.lit("next"), targets[F.col("way")])).otherwise(out), "up": F.when(F.col("role").isin("catch", "catch_all"), F.concat(name, F.lit("#d"))).otherwise(F.col("p_at"))}
    return both.withColumns(placed).select(*nodes.columns, "copy", "at", "up", "targets")


def placed(tree: DataFrame) -> DataFrame:
    """Statements, each copy for itself, with ``at``, where they begin, and ``targets``, where control goes by way."""
    scratch = Scratch(tree.sparkSession, "statements", spread=True)
    nodes = scratch.save(_nodes(without_resources(tree)), "nodes")
    ways = ways_out(nodes, scratch)
    nodes = scratch.save(nodes.join(ways, ["fn", "node"], "left"), "statements")
    start = F.create_map(*map(F.lit, ("next", "exit", "return", "exit", "throw", "throw")))
    parts = [scratch.save(nodes.where("parent IS NULL").withColumns({"copy": F.lit(""), "at": F.lit("in"), "up": F.lit(None).cast("string"), "targets": start}), "level-0")]
    below = nodes.where("parent IS NOT NULL")
    for level in itertools.count(1):
        newest = scratch.save(_below(parts[-1].where(~F.col("kind").isin(*SIMPLE)), below), f"level-{level}")
        if newest.isEmpty():
            return graph.rows_of(iter(parts))
        parts.append(newest)


def _edges_of() -> Column:
    """The edges of a placed statement; those without a target are null or lead to null."""
    kind, at, to = F.col("kind"), F.col("at"), lambda way: F.col("targets")[way]
    here = F.concat("node", "copy")
    part = lambda mark: F.concat(here, F.lit(mark))
    child = lambda c: F.concat(F.col(c), F.col("copy"))
    edge = lambda src, dst, op: F.struct(src.alias("src"), dst.alias("dst"), (F.lit(op) if isinstance(op, str) else op).alias("op"))
    none = F.array().cast("array<struct<src:string,dst:string,op:string>>")
    throws = F.when(F.col("calls"), F.array(edge(at, to("throw"), "throws"))).otherwise(none)
    number = lambda i: F.concat(here, F.lit("#"), i.cast("string"))
    begins = lambda i: F.when(i == 1, at).otherwise(number(i))
    declared = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: edge(begins(i), F.when(i == F.col("parts"), to("next")).otherwise(number(i + 1)), "assign"))
    thrown = F.when(F.col("calls"), F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: edge(begins(i), to("throw"), "throws"))).otherwise(none)
    head, test, fetch, latch, cond, sort = map(part, ("#h", "#t", "#b", "#l", "#c", "#d"))
    first = F.coalesce(child("first"), latch)
    forms = {
        "empty": F.array(edge(at, to("next"), "skip")),
        "expr": F.concat(F.array(edge(at, to("next"), "expr")), throws),
        "local": F.concat(declared, thrown),
        "assert": F.array(edge(at, to("next"), "assume")),
        "return": F.concat(F.array(edge(at, to("return"), "return")), throws),
        "throw": F.array(edge(at, to("throw"), "throw")),
        "break": F.array(edge(at, F.col("targets")[_way(kind, F.col("target"))], "skip")),
        "if": F.array(edge(at, F.coalesce(child("then"), to("next")), "assume"), edge(at, F.coalesce(child("other"), to("next")), "refute")),
        "while": F.array(edge(at, first, "assume"), edge(at, to("next"), "refute"), edge(latch, at, "back")),
        "do": F.array(edge(at, F.coalesce(child("first"), cond), "skip"), edge(cond, at, "assume"), edge(cond, to("next"), "refute")),
        "for": F.array(edge(at, head, "init"), edge(head, first, "assume"), edge(head, to("next"), "refute"), edge(latch, head, "update")),
        "foreach": F.array(
            edge(at, head, "iterator"), edge(at, to("throw"), "throws"), edge(head, test, "has_next"), edge(head, to("throw"), "throws"), edge(test, fetch, "assume"),
            edge(test, to("next"), "refute"), edge(fetch, first, "next"), edge(fetch, to("throw"), "throws"), edge(latch, head, "back"),
        ),
        "switch": F.when(F.col("default").isNull(), F.array(edge(at, to("next"), "default"))).otherwise(none),
    }
    out = F.when(kind == "continue", forms["break"])
    for name, edges in forms.items():
        out = out.when(kind == name, edges)
    out = out.when(kind.isin(*SEQUENCES, "try"), F.when(F.col("first").isNull(), F.array(edge(at, to("next"), "skip"))).otherwise(none))
    out = out.otherwise(F.array(edge(at, to("next"), "unsupported")))
    # What a switch or a try sorts by: the edge that leads to this child, and what no clause catches.
    sorted_in = F.when(F.col("role").isin("case", "default"), F.array(edge(F.col("up"), at, F.col("role")))).when(F.col("role").isin("catch", "catch_all"), F.array(edge(F.col("up"), at, "caught"))).otherwise(none)
    guarded = F.when(F.array_contains("ways", "throw"), F.concat("final", "copy", F.lit("/throw")))
    beyond = F.when(F.col("final").isNull(), to("throw")).otherwise(guarded)
    uncaught = F.when((kind == "try") & F.col("catches") & ~F.col("catches_all"), F.array(edge(sort, beyond, "uncaught"))).otherwise(none)
    return F.concat(out, sorted_in, uncaught)


def lower(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(fn, src, dst, op, node)`` and ``errors(fn, node, kind, problem)``: jumps without a target, and kinds that are not known.

    A loop has one edge back: where several ways lead to its next turn they meet at a location of their own.
    """
    scratch = Scratch(tree.sparkSession, "lowered", spread=True)
    found = scratch.save(placed(tree), "placed")
    edges = scratch.save(found.select("fn", "node", F.inline(_edges_of())).where("dst IS NOT NULL").select("fn", "src", "dst", "op", "node"), "edges")
    backs = edges.where("op = 'back'").select("fn", F.col("src").alias("latch"), F.col("dst").alias("head"))
    turns = scratch.save(backs.join(edges.select("fn", F.col("dst").alias("latch")), ["fn", "latch"], "left_semi").join(edges.groupBy("fn", F.col("dst").alias("latch")).agg(F.count("*").alias("n")), ["fn", "latch"]), "turns")
    single = turns.where("n = 1").select("fn", F.col("latch").alias("dst"), "head")
    out = edges.where("op != 'back'").join(single, ["fn", "dst"], "left").withColumn("dst", F.coalesce("head", "dst")).select("fn", "src", "dst", "op", "node")
    kept = edges.where("op = 'back'").join(turns.where("n > 1").select("fn", F.col("latch").alias("src")), ["fn", "src"], "left_semi").withColumn("op", F.lit("skip"))
    lost = F.col("kind").isin("break", "continue") & F.col("targets")[_way(F.col("kind"), F.col("target"))].isNull()
    problem = F.when(lost, F.lit("no target")).when(~F.col("kind").isin(*KINDS), F.lit("unsupported"))
    errors = found.select("fn", "node", "kind", problem.alias("problem")).where("problem IS NOT NULL").distinct()
    return out.unionByName(kept.select(out.columns)), errors
