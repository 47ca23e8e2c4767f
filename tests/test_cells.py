"""Cell graphs, edits of graphs, paths, ranges, interned states and the registry against brute force."""

from __future__ import annotations

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from conefix.operators import cells, dominators, graph_edits, interning, paths, ranges, scans, summaries
from conefix.session import Scratch
from conefix.streaming import registry

INF = math.inf


# --- programs ----------------------------------------------------------------------


def program(rng, size):
    """Edges of a random structured program: straight statements, branches, nested loops with breaks."""
    edges, place = [], [0]

    def fresh():
        place[0] += 1
        return place[0]

    def statement():
        kind = rng.choice(["add", "add", "set", "below", "above"])
        a = float(rng.randrange(-5, 9))
        return (kind, a, a + rng.randrange(3))

    def block(at, budget, exits):
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["line", "line", "branch", "loop"]) if budget > 0 else "line"
            if kind == "line":
                to = fresh()
                edges.append((at, to, *statement()))
            elif kind == "branch":
                left, right, to = fresh(), fresh(), fresh()
                edges.append((at, left, "below", 0.0, float(rng.randrange(9))))
                edges.append((at, right, "above", float(rng.randrange(9)), 0.0))
                edges.append((block(left, budget - 1, exits), to, *statement()))
                edges.append((block(right, budget - 1, exits), to, *statement()))
            else:
                head, body, to = fresh(), fresh(), fresh()
                edges.append((at, head, *statement()))
                edges.append((head, body, "below", 0.0, float(rng.randrange(5, 40))))
                edges.append((head, to, "above", float(rng.randrange(9)), 0.0))
                end = block(body, budget - 1, [*exits, to])
                if rng.random() < 0.5:
                    onward = fresh()
                    edges.append((end, rng.choice([*exits, to]), "above", float(rng.randrange(30)), 0.0))
                    edges.append((end, onward, "below", 0.0, 60.0))
                    end = onward
                edges.append((end, head, *statement()))
            at = to
        return at

    block(0, size, [])
    kept = {}
    for src, dst, op, a, b in edges:
        kept.setdefault((src, dst), (op, a, b))
    return kept


def step(op, a, b, state):
    lo, hi = state
    if lo > hi:
        return (INF, -INF)
    got = {"add": (lo + a, hi + b), "set": (a, b), "below": (lo, min(hi, b)), "above": (max(lo, a), hi)}[op]
    return got if got[0] <= got[1] else (INF, -INF)


def join(x, y):
    return (min(x[0], y[0]), max(x[1], y[1]))


def widened(old, new):
    if old[0] > old[1]:
        return new
    if new[0] > new[1]:
        return old
    return (-INF if new[0] < old[0] else old[0], INF if new[1] > old[1] else old[1])


def loops_of(edges, entry):
    nodes = {entry} | {n for e in edges for n in e}

    def reach(without):
        seen, todo = set(), [entry] if entry != without else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [d for s, d in edges if s == n and d != without]
        return seen

    live = reach(None)
    back = {(s, d) for s, d in edges if s in live and (s == d or s not in reach(d))}
    inside = {}
    for tail, head in back:
        seen, todo = set(), [tail]
        while todo:
            n = todo.pop()
            if n != head and n not in seen:
                seen.add(n)
                todo += [s for s, d in edges if d == n and s in live]
        inside[head] = inside.get(head, set()) | seen
    return live, back, inside, nodes


def solved(edges, entry, state):
    """Structured iteration: a loop is run until an iterate repeats, and what leaves it is taken from its last run."""
    live, back, inside, _ = loops_of(edges, entry)
    order, seen = [], set()

    def visit(n):
        seen.add(n)
        for d in sorted(d for s, d in edges if s == n and (s, d) not in back):
            if d not in seen:
                visit(d)
        order.insert(0, n)

    visit(entry)
    values, turns = {}, {}

    def inputs(n, known):
        got = [step(*edges[s, n], known[s]) for s, d in edges if d == n and (s, d) not in back and s in live]
        got += [state] if n == entry else []
        out = (INF, -INF)
        for g in got:
            out = join(out, g)
        return out

    def run(places, known):
        skip = set()
        for n in places:
            if n in skip:
                continue
            if n not in inside:
                known[n] = inputs(n, known)
                continue
            body = [m for m in places if m in inside[n]]
            iterate, turns[n] = inputs(n, known), 0
            while True:
                known[n] = iterate
                run(body, known)
                pre = (INF, -INF)
                for s, d in back:
                    if d == n:
                        pre = join(pre, step(*edges[s, d], known[s]))
                following = widened(iterate, pre)
                turns[n] += 1
                if following == iterate:
                    break
                iterate = following
            skip |= set(body)

    run([n for n in order if n in live], values)
    return values, turns


def frames(spark, programs):
    rows = [(f, s, d, *e) for f, (edges, _) in programs.items() for (s, d), e in edges.items()]
    edges = spark.createDataFrame(rows, "fn string, src long, dst long, op string, a double, b double").repartition(3)
    return edges, spark.createDataFrame([(f, 0, *s) for f, (_, s) in programs.items()], "fn string, entry long, lo double, hi double")


def shown(values, g):
    return {(r["fn"], r["loc"]): (r["lo"], r["hi"], r["iterations"]) for r in values.at_locations(g.locs).collect()}


def wanted(programs):
    out = {}
    for f, (edges, state) in programs.items():
        values, turns = solved(edges, 0, state)
        out |= {(f, n): (*v, turns.get(n)) for n, v in values.items()}
    return out


@pytest.fixture(scope="module")
def programs():
    rng = random.Random(7)
    made = {f"p{i}": (program(rng, rng.randrange(0, 3)), (0.0, float(rng.randrange(4)))) for i in range(40)}
    return made | {"self": ({(0, 1): ("add", 0.0, 0.0), (1, 1): ("add", 1.0, 1.0), (1, 2): ("below", 0.0, 9.0)}, (0.0, 0.0)), "head": ({(0, 1): ("below", 0.0, 9.0), (1, 0): ("add", 1.0, 1.0), (0, 2): ("above", 9.0, 0.0)}, (0.0, 0.0))}


@pytest.fixture(scope="module")
def built(spark, programs):
    return cells.build(*frames(spark, programs))


def test_loops_by_dominators(spark, programs, built):
    got = {(r["fn"], r["loc"]): r["nest"] for r in built.locs.collect()}
    for f, (edges, _) in programs.items():
        live, _, inside, _ = loops_of(edges, 0)
        for n in live:
            around = sorted((h for h in inside if n in inside[h]), key=lambda h: -len(inside[h]))
            assert got[f, n] == around, (f, n)
    pairs = dominators.dominators(*frames(spark, {"x": programs["p1"]})).collect()
    edges = programs["p1"][0]
    live = loops_of(edges, 0)[0]
    for n in live:
        own = {r["dominator"] for r in pairs if r["loc"] == n}
        assert own == {m for m in live if m == n or n not in loops_of({e: v for e, v in edges.items() if m not in e or e[1] == m}, 0)[0] or m == 0}


def test_values_equal_structured_iteration(programs, built):
    assert shown(cells.evaluate(built), built) == wanted(programs)


def test_rows_passes_and_rounds_make_the_same_cells(programs, built, monkeypatch):
    """Small programs are computed within a row each, in one pass or in several; larger ones round by round."""
    every = lambda v: (sorted(map(str, v.cells.collect())), sorted(map(str, v.ended.collect())))
    few = sorted(programs)[:12]
    g = cells.CellGraph(*(df.where(F.col("fn").isin(few)) for df in (built.edges, built.locs, built.entries)))
    by_rounds = cells._by_rounds
    monkeypatch.setattr(cells, "_by_rounds", None)
    once = every(cells.evaluate(g))
    monkeypatch.setattr(cells, "ROUNDS", 4)
    assert every(cells.evaluate(g)) == once
    monkeypatch.setattr(cells, "_by_rounds", by_rounds)
    monkeypatch.setattr(cells, "LOCAL", 6)
    assert every(cells.evaluate(g)) == once


def test_programs_of_one_shape_are_placed_once(spark, programs, monkeypatch):
    """Twins have values of their own, but loops, joins and ordinals are found once; a program of many edges is a shape of its own."""
    some = {f: programs[f] for f in ("p1", "p2", "self")}
    twins = some | {f"{f}'": ({e: (op, a + 1, b + 1) for e, (op, a, b) in edges.items()}, (0.0, 7.0)) for f, (edges, _) in some.items()}
    seen, reachable = [], cells.dominators.reachable
    monkeypatch.setattr(cells.dominators, "reachable", lambda edges, entries: seen.append(entries.select("fn").distinct().count()) or reachable(edges, entries))
    rows = lambda g: (sorted(map(str, g.edges.select(sorted(g.edges.columns)).collect())), sorted(map(str, g.locs.collect())))
    made = rows(cells.build(*frames(spark, twins)))
    assert seen == [3]
    monkeypatch.setattr(cells, "SHAPED", 3)
    assert rows(cells.build(*frames(spark, twins))) == made and seen[1] > 3


def test_demand_computes_only_its_cone(spark, programs, built):
    asked = spark.createDataFrame([(f, max(1, max(n for e in edges for n in e) // 3)) for f, (edges, _) in programs.items()], "fn string, loc long").join(built.locs.select("fn", "loc"), ["fn", "loc"], "left_semi")
    part, whole = cells.evaluate(built, wanted=asked), wanted(programs)
    got = shown(part, built)
    keys = [(r["fn"], r["loc"]) for r in asked.collect()]
    assert all(got[k] == whole[k] for k in keys)
    assert part.cells.count() < cells.evaluate(built).cells.count()


def changed_programs(programs, rng, some):
    changes, after = [], {}
    for f, (edges, state) in programs.items():
        after[f] = (dict(edges), state)
        if f in some:
            key = rng.choice(sorted(edges))
            new = ("add", float(rng.randrange(-9, 9)), 12.0) if edges[key][0] in ("add", "set") else (edges[key][0], float(rng.randrange(9)), float(rng.randrange(9)))
            after[f][0][key] = new
            changes.append((f, *key, *new))
    return changes, after


def test_edits_in_place_equal_from_scratch_and_rewrite_few_buckets(spark, programs, built):
    store = cells.CellStore(built, buckets=16)
    store.fill()
    rng = random.Random(3)
    files = lambda: {p: (os.stat(p).st_mtime_ns, os.stat(p).st_ino) for p in glob.glob(f"{store.path('cells').removeprefix('file://')}/bucket=*/*.parquet")}
    now = programs
    for some in (["p3", "p8"], ["p1", "p3", "p20"], []):
        before = files()
        changes, now = changed_programs(now, rng, some)
        touched = store.edit(spark.createDataFrame(changes, "fn string, src long, dst long, op string, a double, b double"))
        after = files()
        rewritten = {p.split("bucket=")[1].split("/")[0] for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}
        assert rewritten == {str(b) for b in touched} and len(touched) <= len(some)
        assert shown(store.read(), store.graph) == wanted(now)


def test_dirtying_keeps_what_an_edit_does_not_reach(spark):
    """A loop between two straight lines: an edit behind it keeps the loop, one within it keeps the first iterate."""
    edges = {(0, 1): ("add", 1.0, 1.0), (1, 2): ("below", 0.0, 9.0), (2, 1): ("add", 1.0, 2.0), (1, 3): ("above", 2.0, 0.0), (3, 4): ("add", 1.0, 1.0)}
    g = cells.build(*frames(spark, {"f": (edges, (0.0, 0.0))}))
    values = cells.evaluate(g)
    roles = lambda v: sorted((r["loc"], r["role"], tuple(r["ctx"])) for r in v.cells.collect())
    change = lambda s, d: spark.createDataFrame([("f", s, d)], "fn string, src long, dst long")
    whole = roles(values)
    behind = cells.dirtied(g, values, change(3, 4))
    assert roles(behind) == [r for r in whole if r[0] != 4] and behind.ended.count() == 1
    within = cells.dirtied(g, values, change(2, 1))
    assert roles(within) == [(0, "at", ()), (1, "iter", (0,)), (2, "at", (0,))] and within.ended.count() == 0
    # Where only a part has been asked for, the cone ends at empty cells.
    part = cells.evaluate(g, wanted=spark.createDataFrame([("f", 0)], "fn string, loc long"))
    assert roles(cells.dirtied(g, part, change(0, 1))) == [(0, "at", ())]


def test_malformed_transfers_are_error_rows(spark):
    graph = [("f", c, k) for c, k in (("s1", "stmt"), ("s2", "stmt"), ("x", "state"), ("y", "state"), ("z", "state"))]
    comps = [("f", "s1", "x"), ("f", "y", "x"), ("f", "s2", "y"), ("f", "s1", "z"), ("f", "x", "z"), ("f", "y", "z")]
    found = cells.transfer_inputs(spark.createDataFrame(graph, "fn string, cell string, kind string"), spark.createDataFrame([(*c, "transfer") for c in comps], "fn string, src string, dst string, kind string"))
    got = {r["cell"]: (r["stmt"], r["state"], r["error"]) for r in found.collect()}
    assert got == {"x": ("s1", "y", None), "y": (None, None, "1 statements, 0 states, 1 inputs"), "z": (None, None, "1 statements, 2 states, 3 inputs")}


# --- edits of graphs ---------------------------------------------------------------


def test_graph_edits_and_clashes(spark):
    line = [("f", i, i + 1, "add", float(i), float(i)) for i in range(6)] + [("f", 1, 3, "add", 9.0, 9.0), ("g", 0, 1, "below", 0.0, 5.0), ("g", 0, 2, "above", 5.0, 0.0), ("g", 1, 0, "add", 1.0, 1.0)]
    edges = spark.createDataFrame(line, "fn string, src long, dst long, op string, a double, b double")
    exits = spark.createDataFrame([("f", 6), ("g", 2)], "fn string, loc long")
    kinds = "edit string, fn string, kind string, at long, upto long, op string, a double, b double"
    rows = [("a", "f", "add", 0, None, "set", 7.0, 7.0), ("b", "f", "modify", 1, 3, "set", 8.0, 8.0), ("c", "f", "delete", 5, 6, None, None, None), ("d", "g", "header", 0, None, None, 1.0, 2.0), ("e", "g", "add", 7, None, "set", 1.0, 1.0), ("z", "f", "paint", 0, None, None, None, None)]
    got, errors = graph_edits.apply_edits(edges, spark.createDataFrame(rows, kinds), exits)
    assert sorted(map(tuple, got.collect())) == sorted([("f", 0, 7, "set", 7.0, 7.0), ("f", 7, 1, "add", 0.0, 0.0), ("f", 1, 3, "set", 8.0, 8.0), ("f", 3, 4, "add", 3.0, 3.0), ("f", 4, 5, "add", 4.0, 4.0), ("f", 5, 6, "add", 0.0, 0.0), ("g", 0, 1, "below", 1.0, 2.0), ("g", 0, 2, "above", 1.0, 2.0), ("g", 1, 0, "add", 1.0, 1.0)])
    assert sorted((r["edit"], r["src"], r["edits"]) for r in errors.collect()) == [("e", None, 0), ("z", None, 0)]
    rows = [("a", "f", "add", 4, None, "set", 7.0, 7.0), ("b", "f", "delete", 3, 4, None, None, None), ("c", "f", "add", 0, None, "set", 1.0, 1.0)]
    got, errors = graph_edits.apply_edits(edges.where("fn = 'f'"), spark.createDataFrame(rows, kinds), exits)
    assert {(r["edit"], r["src"], r["dst"], r["edits"]) for r in errors.collect()} == {("a", 4, 5, 2), ("b", 4, 5, 2)}
    assert got.count() == 8 and got.where("op = 'set'").count() == 1
    rows = [("b", "f", "delete", 3, 4, None, None, None)]
    got, errors = graph_edits.apply_edits(edges.where("fn = 'f'"), spark.createDataFrame(rows, kinds), exits)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [(0, 1), (1, 2), (1, 3), (2, 3), (3, 5), (5, 6)] and errors.isEmpty()


# --- paths and ranges --------------------------------------------------------------


def test_linear_paths(spark):
    rows = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 10), (20, 21), (21, 22), (21, 23), (30, 30), (None, 1), (5, None), (1, 2)]
    got = {r["node"]: (r["end"], r["length"], r["kind"]) for r in paths.linear_paths(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {1: (4, 3, "end"), 2: (4, 2, "end"), 3: (4, 1, "end"), 4: (4, 0, "end"), 10: (None, None, "cycle"), 11: (None, None, "cycle"), 12: (None, None, "cycle"), 20: (21, 1, "fork"), 21: (21, 0, "fork"), 22: (22, 0, "end"), 23: (23, 0, "end"), 30: (None, None, "cycle")}
    assert paths.linear_paths(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_a_chain_of_a_hundred_thousand(spark):
    got = paths.linear_paths(spark.range(100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert got.agg(F.count("*"), F.min("end"), F.max("end"), F.sum("length"), F.count_if(F.expr("length = 100000 - node"))).first()[:] == (100_001, 100_000, 100_000, 100_000 * 100_001 // 2, 100_001)


def test_ranges_reach_what_a_plain_comparison_reaches(spark):
    rng = random.Random(2)
    held = [(k, i, float(rng.randrange(9)), float(rng.randrange(9, 20))) for k in range(3) for i in rng.sample(range(-40, 300), 90)]
    writes = [(rng.randrange(4), *(rng.choice([None, rng.randrange(-60, 330)]) for _ in range(2)), float(rng.randrange(-9, 30)), float(rng.randrange(30, 40))) for _ in range(60)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ranges.ranged_write(spark.createDataFrame(held, "k long, i long, lo double, hi double"), spark.createDataFrame(writes, "k long, first long, last long, lo double, hi double"), "k", "i")
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for k, i, lo, hi in held:
        hit = [(a, b) for w, f, u, a, b in writes if w == k and (f is None or f <= i) and (u is None or i <= u)]
        want.append((k, i, min([lo, *(a for a, _ in hit)]), max([hi, *(b for _, b in hit)])))
    assert rows == sorted(want)


def test_blocks_make_up_their_range(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(a - 2, 70, 5)]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", ranges.blocks(F.col("a"), F.col("b")).alias("p")).collect():
        covered = [x for p in r["p"] for x in range(p["block"] << p["level"], (p["block"] + 1) << p["level"])]
        assert sorted(covered) == list(range(r["a"], r["b"] + 1)) and len(r["p"]) <= 14


# --- interned states, running sums ---------------------------------------------------


def test_states_are_stored_once_and_pairs_found_again(spark):
    rows = [(u, v, float(u % 3), float(u % 3 + 5)) for u in range(12) for v in ("x", "y")] + [(20, "z", 1.0, 2.0)]
    store = interning.Interned(spark)
    named = store.intern(spark.createDataFrame(rows, "user long, var string, lo double, hi double"), ["user"])
    assert store.states.select("digest").distinct().count() == 4 and store.states.count() == 7
    key = {r["user"]: r["digest"] for r in named.collect()}
    asked = spark.createDataFrame([(0, key[0], key[1]), (3, key[3], key[4]), (5, key[5], key[20])], "user long, a string, b string")
    first = store.combined(asked)
    assert (store.hits, store.misses) == (0, 2) and {r["user"]: r["digest"] is None for r in first.collect()} == {0: False, 3: False, 5: True}
    again = store.combined(asked)
    assert (store.hits, store.misses) == (2, 2) and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, first.collect()), key=str)
    assert {(r["var"], r["lo"], r["hi"]) for r in store.rows(again).collect()} == {("x", 0.0, 6.0), ("y", 0.0, 6.0)}
    wide = store.rows(store.combined(asked, "widen").where("user = 0")).collect()
    assert store.misses == 4 and {(r["lo"], r["hi"]) for r in wide} == {(0.0, INF)}


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, descending):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.choice([None, i % 7])) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
        got = {r["i"]: (r["s"], r["l"]) for r in scans.running(frame, ["g"], ["i"], {"s": F.col("v")}, {"l": F.col("v")}, descending).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state: dict = {}
    for g, i, v in sorted(rows, key=lambda r: -r[1] if descending else r[1]):
        total, last = state.get(g, (0, None))
        last = v if v is not None else last
        assert got[i] == (total, last)
        state[g] = (total + (v or 0), last)


# --- the registry ------------------------------------------------------------------


def test_registry_survives_restarts(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, rng.choice(["add"] * 5 + ["pop", "stale"]), rng.choice(["c1", "c2"]), str(rng.randrange(6))) for i in range(300)]
    rows = [(k, i, op, None if op == "pop" and rng.random() < 0.5 or op == "stale" else ctx, None if op == "pop" else caller) for k, i, op, ctx, caller in rows]
    want = []
    for callee in range(4):
        _, gone = registry.changed(set(), iter([r[1:] for r in rows if r[0] == callee]))
        want += [(callee, seq, ctx, caller, str(callee) == caller) for seq, ctx, caller in gone]
    scratch = Scratch(spark, "registry-test")
    source, target, checkpoint = (f"{scratch.root}/{n}" for n in ("source", "target", "checkpoint"))
    schema = "callee long, seq long, op string, ctx string, caller string"
    for part in (rows[:90], rows[90:91], rows[91:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(source)
        registry.follow(spark.readStream.schema(schema).parquet(source), target, checkpoint)
    registry.follow(spark.readStream.schema(schema).parquet(source), target, checkpoint)  # nothing new
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(want) and len(want) > 20


# --- calls -------------------------------------------------------------------------


def test_summaries_by_demand(spark):
    """Contexts are shared, missing callees and circles leave the state open, programs that nobody asks for are not touched."""
    lines = {
        "main": [(0, 1, "call", "f"), (1, 2, "set", 4.0), (2, 3, "call", "f"), (3, 4, "call", "nobody")],
        "other": [(0, 1, "call", "f"), (1, 2, "call", "loop")],
        "f": [(0, 1, "add", 1.0)],
        "loop": [(0, 1, "add", 1.0), (1, 0, "call", "f"), (0, 2, "above", 3.0)],
        "rec": [(0, 1, "add", 1.0), (1, 2, "call", "rec")],
        "ping": [(0, 1, "call", "pong"), (1, 2, "add", 1.0)],
        "pong": [(0, 1, "call", "ping"), (1, 2, "set", 7.0)],
        "unused": [(0, 1, "add", 1.0)],
    }
    rows = [(f, s, d, op, 0.0 if op == "call" else x, 0.0 if op == "call" else x, x if op == "call" else None) for f, own in lines.items() for s, d, op, x in own]
    edges = spark.createDataFrame(rows, "fn string, src long, dst long, op string, a double, b double, callee string")
    entries = spark.createDataFrame([(f, 0, 0.0, 0.0) for f in lines], "fn string, entry long, lo double, hi double")
    exits = spark.createDataFrame([(f, max(d for _, d, _, _ in own)) for f, own in lines.items()], "fn string, loc long")
    demand = spark.createDataFrame([("main", 1.0, 1.0), ("other", 4.0, 4.0), ("rec", 0.0, 0.0), ("ping", 0.0, 0.0)], "fn string, lo double, hi double")
    found = summaries.solve(cells.build(edges, entries), exits, demand)
    contexts = sorted((r["fn"], r["lo"], r["hi"]) for r in found.contexts.collect())
    top = (-INF, INF)
    assert contexts == sorted([("main", 1.0, 1.0), ("other", 4.0, 4.0), ("f", 1.0, 1.0), ("f", 4.0, 4.0), ("loop", 5.0, 5.0), ("f", 6.0, 6.0), ("f", 6.0, INF), ("rec", 0.0, 0.0), ("rec", *top), ("ping", 0.0, 0.0), ("pong", *top), ("ping", *top)])
    states = {(r["fn"], r["loc"]): (r["lo"], r["hi"]) for r in found.values.at_locations(found.graph.locs).collect()}
    main = [states["main#1.0#1.0", k] for k in range(5)]
    assert main == [(1.0, 1.0), (2.0, 2.0), (4.0, 4.0), (5.0, 5.0), top]
    assert states["other#4.0#4.0", 2] == (5.0, INF) and states["rec#0.0#0.0", 2] == top and states["ping#0.0#0.0", 2] == top
    places = spark.createDataFrame([("f", 0), ("f", 1)], "fn string, loc long")
    assert sorted(map(tuple, summaries.located(found, places).collect())) == [("f", 0, 1.0, INF, 4), ("f", 1, 2.0, INF, 4)]
    assert found.asks.where("callee = 'f'").select("fn").distinct().count() == 3
