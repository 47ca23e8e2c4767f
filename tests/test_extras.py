"""Sinks, line diffs, octagons and random workloads."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from conefix.functions.octagon import MAX_VARIABLES, Octagon
from conefix.operators import textdiff
from conefix.plans import analysis, examples, statements, workload
from conefix.plans.incremental import SOURCES, Analysis
from conefix.session import Scratch
from conefix.sources import facts, java, sinks

# --- diffs -------------------------------------------------------------------


def patched(a: list[str], found) -> list[str]:
    out, at = [], 0
    for start, length, _, new in found:
        out += a[at:start] + new
        at = start + length
    return out + a[at:]


def test_hunks_rebuild_the_new_text():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz"))
        found = textdiff.hunks(a, b)
        assert patched(a, found) == b and all(b[j : j + len(new)] == new for _, _, j, new in found)
        assert (found == []) == (a == b)
    assert textdiff.hunks(list("abc"), list("axc")) == [(1, 1, 1, ["x"])]
    assert textdiff.hunks(["{", "}", "{", "}"], ["{", "}", "new", "{", "}"]) == [(2, 0, 2, ["new"])]
    assert textdiff.hunks([], ["a"]) == [(0, 0, 0, ["a"])] and textdiff.hunks(["a"], []) == [(0, 1, 0, [])]


def test_large_stretches_without_anchors_are_aligned(monkeypatch):
    rng = random.Random(4)
    a = [rng.choice("abcdef") for _ in range(2400)]
    b = [x for x in a if rng.random() < 0.9]
    assert len(a) * len(b) > textdiff.TABLE_CELLS
    pairs = textdiff.matches(["x", *a, "y"], ["z", *b, "w"])
    assert len(pairs) == len(b) and all(x < u and y < v for (x, y), (u, v) in itertools.pairwise(pairs))
    assert all(a[x - 1] == b[y - 1] for x, y in pairs)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 80))] for _ in range(2))
        want = len(textdiff._common(a, b))
        monkeypatch.setattr(textdiff, "TABLE_CELLS", rng.choice([0, 9, 200]))
        pairs = sorted(textdiff._common_by_halves(a, b))
        assert len(pairs) == want and all(a[x] == b[y] for x, y in pairs) and all(x < u and y < v for (x, y), (u, v) in itertools.pairwise(pairs))


def test_diff_of_files(spark):
    old, new = (spark.createDataFrame(r, "path string, text string") for r in ([("a", "1\n2\n3"), ("b", "same"), ("c", "gone"), ("n", None)], [("a", "1\n3\n4"), ("b", "same"), ("d", "come"), ("n", "x")]))
    got = [tuple(r) for r in textdiff.diff(old, new).orderBy("prev_start").collect()]
    assert got == [("a", 1, 1, 1, []), ("a", 3, 0, 2, ["4"])]


def test_statement_edits_rebuild_the_new_version():
    """Random trees: applying the edits to the old statements gives the new ones."""
    rng = random.Random(9)

    def tree(depth: int) -> list:
        return [[f"s{rng.randrange(6)} ;"] if depth > 1 or rng.random() < 0.7 else [f"if ( c{rng.randrange(3)} )", [tree(depth + 1)]] for _ in range(rng.randrange(5))]

    def flat(t: list) -> int:
        return sum(1 + sum(map(flat, s[1])) if len(s) > 1 else 1 for s in t)

    def replayed(old: list, new: list, path: str, found: list) -> list:
        """The old list after its edits, which are taken from the front of ``found``; new statements come from the new list in order."""
        out, at, taken = [], 0, 0
        while True:
            here = found and found[0][1].startswith(path) and found[0][1][len(path) :].split(".")[0].split("/")[0]
            place = int(here) if here else len(old)
            while at < place:
                out.append(old[at])
                at, taken = at + 1, taken + 1
            if not here:
                return out
            if "/" in found[0][1][len(path) :]:
                head, bodies = old[place]
                out.append([head, [replayed(b, new[taken][1][n], f"{path}{place}.{n}/", found) for n, b in enumerate(bodies)]])
                at, taken = at + 1, taken + 1
            else:
                _, _, gone, come, _ = found.pop(0)
                out += new[taken : taken + come]
                at, taken = at + gone, taken + come

    for _ in range(400):
        old = tree(0)
        new = [s for s in old if rng.random() < 0.8] + tree(0)[:2]
        for s in new:
            if len(s) > 1 and rng.random() < 0.5:
                new[new.index(s)] = [s[0], [tree(1)]]
        found = list(statements.edits_of(old, new))
        assert (not found) == (old == new) and sum(e[3] for e in found) <= flat(new)
        assert replayed(old, new, "", list(found)) == new
    source = 'class A { int x = f(1); static { go(); } A(int a, int b) { do { a--; } while (a > 0); try (R r = open()) { r.read("{;"); } catch (E e) { } finally { end(); } } enum K { P } }'
    assert set(statements.methods_of(source)) == {"A#A/2"} and len(statements.methods_of(source)["A#A/2"][1]) == 2


# --- octagons ----------------------------------------------------------------


def holds(o: Octagon, names: str, point: tuple[int, ...]) -> bool:
    value = dict(zip(names, point, strict=True))
    row = [s * value[n] for n in o.names for s in (1, -1)]
    return all(row[j] - row[i] <= o.m[i, j] for i in range(len(row)) for j in range(len(row)))


def points(o: Octagon, names: str, size: int = 4) -> set[tuple[int, ...]]:
    """The whole points of an octagon in a small box."""
    return {p for p in itertools.product(range(-size, size + 1), repeat=len(names)) if holds(o, names, p)}


def drawn(rng: random.Random, names: str) -> Octagon:
    o = Octagon.top(names)
    for _ in range(rng.randrange(6)):
        terms = [(rng.choice((1, -1)), n) for n in rng.sample(names, rng.choice((1, 2)))]
        o = o.constrain(terms, rng.randrange(-2, 5))
    return o


def test_octagon_lattice_and_transfer():
    rng, names = random.Random(11), "xyz"
    for _ in range(60):
        a, b = drawn(rng, names), drawn(rng, names)
        p, q = points(a, names), points(b, names)
        assert points(a.close(), names) == p and (not p or not a.is_bottom())
        assert points(a.meet(b), names) == p & q and p | q <= points(a.join(b), names)
        assert a.implies(a.join(b)) and b.implies(a.join(b)) and p | q <= points(a.widen(a.join(b)), names)
        assert not a.implies(b) or p <= q
        if p:
            assert all(a.bounds("x")[0] <= v[0] <= a.bounds("x")[1] for v in p)
            for sign, other, c in ((1, "y", 1), (-1, "y", 0), (1, "x", 2), (-1, "x", 1)):
                after = a.assign("x", source=(sign, other, c))
                for x, y, z in p:
                    assert holds(after, names, (sign * (y if other == "y" else x) + c, y, z))
            assert all(holds(a.assign("x", (7.0, 7.0)), names, (7, y, z)) for _, y, z in p)
    full = Octagon.top([f"v{i}" for i in range(MAX_VARIABLES)])
    assert full.constrain([(1, "v0")], 3).assign("new", (1.0, 1.0)).bounds("new") == (-float("inf"), float("inf"))
    assert (("x", 1, "y", -1, 2.0) in Octagon.top("xy").constrain([(1, "x"), (-1, "y")], 2).rows())


def test_octagon_widening_ends():
    o = Octagon.top("i").assign("i", (0.0, 0.0))
    for _ in range(5):
        o = o.widen(o.join(o.assign("i", source=(1, "i", 1))))
    assert o.bounds("i") == (0.0, float("inf"))


# --- sinks and workloads -----------------------------------------------------


@pytest.fixture(scope="module")
def solved(spark):
    parsed = java.parse_sources(spark.createDataFrame([("wages", examples.PROGRAMS["wages"])], "path string, text string"))
    methods, edges = (java.facts_of(parsed, k).withColumnRenamed("path", "program") for k in ("method", "edge"))
    scratch = Scratch(spark, "test")
    bodies = scratch.save(analysis.bodies_of(edges, methods), "bodies")
    demand = methods.where("method_name = 'main'").select("program", "fn", F.lit("{}").alias("entry"))
    return edges.persist(), bodies, analysis.demanded(bodies, demand, scratch).persist()


def test_dot_and_stats(spark, solved, tmp_path):
    edges, bodies, table = solved
    cells = analysis.cells_of(table)
    drawn_lines = sinks.cells_dot(cells, edges, limit=3)
    assert drawn_lines.select("graph").distinct().count() == 3 and drawn_lines.where("line LIKE '%palegreen%'").count() > 3
    assert sinks.cfg_dot(edges).where("rank = 0").count() == 6
    calls = spark.createDataFrame([("Payroll#main()", "Payroll#net(int)")], "src_fn string, dst_fn string")
    whole = sinks.cfg_dot(edges, calls)
    assert whole.where("rank = 0").count() == 1 and whole.where("line LIKE '%label=\"enters\"%'").count() == 1
    row = sinks.stats(table, bodies).first()
    assert row["contexts"] == row["methods"] == 5 and row["dependencies"] == 4 and row["self_loops"] == 0 and row["cells"] >= row["filled"] > 10
    assert any("[90.0, 90.0]" in r["line"] for r in sinks.summaries(cells).collect()) and sinks.summaries(cells).count() == 5
    sinks.write_lines(drawn_lines, ["graph", "rank", "line"], f"{tmp_path}/dot")
    assert spark.read.text(f"{tmp_path}/dot").count() == drawn_lines.count()


def test_call_graph_text_comes_back(spark, tmp_path):
    calls = spark.createDataFrame([("a#b()", "c#d()"), ("a#b()", "e#f()"), ("c#d()", "a#b()")], "caller string, callee string")
    lines = sinks.call_graph_lines(calls)
    numbered = lines.withColumn("n", F.concat_ws("|", "caller", "rank"))
    assert {tuple(r) for r in facts.call_graph(numbered.withColumnRenamed("line", "value").select("n", "value", F.lit("f").alias("path")), ["n"], ["path"]).drop("path").collect()} == {tuple(r) for r in calls.collect()}
    assert sinks.call_graph_dot(calls).where("rank = 2").count() == 3


def test_tables(spark):
    means = spark.createDataFrame([("p_1", 0.05, 2.0), ("q", 4.0, None)], "program string, batch double, incr double")
    lines = [r["line"] for r in sinks.latex_rows(means, "program", ["batch", "incr"]).orderBy("last", "program").collect()]
    assert lines == [r"p\_1 & $<$0.1 & 2.0 \\", r"q & 4.0 & -- \\", r"average & 2.0 & 2.0 \\"]
    assert [r["line"] for r in sinks.csv_rows(means, "program", ["batch", "incr"]).collect()] == ["0.050,2.000", "4.000,"]
    assert sinks.latency_lines(means, "incr").first()["line"] == "2.000"


def test_workload_is_repeatable_and_analysable(spark):
    made = workload.edits(spark, 4000, 7)
    assert made.exceptAll(workload.edits(spark.newSession(), 4000, 7)).isEmpty() and made.exceptAll(workload.edits(spark, 4000, 8)).count() > 3000
    shares = {r["kind"]: r["count"] / 4000 for r in made.groupBy("kind").count().collect()}
    assert all(abs(shares[k] - s) < 0.03 for k, s in workload.SHARES)
    asked = workload.demands(spark, 50, 7)
    assert asked.exceptAll(workload.demands(spark, 50, 7)).isEmpty() and {r["fn"] for r in asked.collect()} <= {f"M{i}#m{i}(int)" for i in range(4)}
    early, late = (workload.program(made, n) for n in (10, 12))
    kept = Analysis(spark, early.select(*[c.split()[0] for c in SOURCES.split(", ")]))
    kept.query()
    kept.edit(late)
    rows = lambda a: {(r["fn"], r["entry"], r["loc"]): r["state"] for r in a.query().collect()}
    assert rows(kept) == rows(Analysis(spark, late))
