"""The engine: lattices, graphs, sources, the Java front end, demand and edits."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from conefix.functions.interval import Itv
from conefix.operators import analytics, edits, graph, states
from conefix.plans import analysis, examples
from conefix.plans.incremental import SOURCES, Analysis
from conefix.sources import facts, java
from conefix.streaming.edits import EDITS, follow

INF = math.inf


def test_lattice_laws(spark):
    rng = random.Random(2)
    rows = [tuple(sorted(rng.choice([-INF, -3.0, 0.0, 1.5, 7.0, INF]) for _ in range(2)) + sorted(rng.choice([-INF, -2.0, 0.0, 4.0, INF]) for _ in range(2))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    x, y = Itv.of("a", "b"), Itv.of("c", "d")
    both = lambda p, q: (p.lo == q.lo) & (p.hi == q.hi)
    laws = [both(x.join(y), y.join(x)), both(x.join(x), x), x.implies(x.join(y)), x.meet(y).is_bottom() | x.meet(y).implies(x), x.join(y).implies(x.widen(x.join(y))), both(x.widen(x), x)]
    assert df.select(*(F.bool_and(law).alias(f"l{i}") for i, law in enumerate(laws))).first() == (True,) * len(laws)


@pytest.mark.parametrize("op", ["add", "sub", "mul", "div", "mod"])
def test_interval_arithmetic_holds_all_values(spark, op):
    rng = random.Random(op)
    plain = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "mod": math.fmod}[op]
    rows = [tuple(sorted(rng.randrange(-9, 10) for _ in range(2)) + sorted(rng.randrange(-9, 10) for _ in range(2))) for _ in range(150)]
    got = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double").select("*", *getattr(Itv.of("a", "b"), op)(Itv.of("c", "d"))).collect()
    for a, b, c, d, lo, hi in got:
        for p in range(int(a), int(b) + 1):
            for q in range(int(c), int(d) + 1):
                assert q == 0 and op in ("div", "mod") or lo <= plain(p, q) <= hi
        want = analysis.evaluate(["bin", {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}[op], ["var", "x"], ["var", "y"]], {"x": (a, b), "y": (c, d)})
        assert (lo, hi) == want


def test_inner_and_outer_joins_of_states(spark):
    rows = [("g", 1, "x", 0.0, 1.0), ("g", 1, "y", 0.0, 1.0), ("g", 2, "x", 5.0, 6.0)]
    joined = states.join_numeric(spark.createDataFrame(rows, "g string, s int, var string, lo double, hi double"), ["g"], "s").collect()
    assert [tuple(r) for r in joined] == [("g", "x", 0.0, 6.0)]
    old, new = (spark.createDataFrame(r, "var string, lo double, hi double") for r in ([("x", 0.0, 1.0), ("y", 0.0, 1.0), ("z", 1.0, 1.0)], [("x", 0.0, 9.0), ("y", -1.0, 9.0)]))
    assert [tuple(r) for r in states.widen_numeric(old, new, ["var"]).collect()] == [("x", 0.0, INF)]
    ids = spark.createDataFrame([("p", "b", 1.0, 2.0), ("p", "a", 0.0, 0.0), ("q", "a", 0.0, 0.0), ("q", "b", 1.0, 2.0), ("q", "c", -INF, INF), ("r", "a", 0.0, 0.0)], "s string, var string, lo double, hi double")
    got = {r["s"]: r["id"] for r in ids.groupBy("s").agg(states.state_id(F.col("var"), F.col("lo"), F.col("hi")).alias("id")).collect()}
    assert got["p"] == got["q"] != got["r"]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_graph_operators_match_brute_force(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(24)})
    paths = set(pairs)
    while more := {(a, d) for a, b in paths for c, d in pairs if b == c} - paths:
        paths |= more
    df = edges_of(spark, pairs)
    assert {tuple(r) for r in graph.closure(df).collect()} == paths
    nodes = {n for p in pairs for n in p}
    want = {n: min([n] + [m for m in nodes if (n, m) in paths and (m, n) in paths]) for n in nodes}
    assert {r["node"]: r["component"] for r in graph.strong_components(df).collect()} == want
    found = {(r["node"], r["indegree"]) for r in graph.by_indegree(df).collect()}
    assert found == {(n, sum(d == n for _, d in pairs)) for n in nodes}


def test_loops_regions_and_back_edges(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (1, 5), (5, 6)]
    df = edges_of(spark, pairs)
    assert {r[0] for r in graph.natural_loop(df, 1, 3).collect()} == {2, 3}
    assert {tuple(r) for r in graph.region(df, 1, 5).collect()} == {(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (1, 5)}
    with_fn = df.selectExpr("'f' AS fn_id", "src", "dst", "0 AS entry").union(edges_of(spark, [(0, 1), (1, 0)]).selectExpr("'g'", "src", "dst", "0"))
    assert {tuple(r) for r in graph.back_edges(with_fn).collect()} == {("f", 3, 1), ("g", 1, 0)}


def test_inherited_names(spark):
    """Random hierarchies with several parents against a plain closure, under several orders of names."""
    rng = random.Random(41)
    for _ in range(3):
        names = [f"{rng.choice('kqz')}{i}" for i in range(18)]
        rng.shuffle(names)
        parents = {c: rng.sample(names[:k], min(k, rng.randrange(3))) for k, c in enumerate(names)}
        own = {c: {f"f{rng.randrange(12)}" for _ in range(rng.randrange(3))} for c in names}

        def everything(c):
            return own[c].union(*(everything(p) for p in parents[c]))

        tree, fields = [(c, p) for c, ps in parents.items() for p in ps], [(c, f) for c, fs in own.items() for f in fs]
        got: dict[str, set] = {}
        for r in graph.inherited(spark.createDataFrame(tree, "child string, parent string"), spark.createDataFrame(fields, "class_id string, name string")).collect():
            got.setdefault(r["class_id"], set()).add(r["name"])
        assert got == {c: everything(c) for c in names if everything(c)}


def test_text_sources(spark, tmp_path):
    lines = ["CALLER: a.B#m()", "\tCALLEE: static a.C#n(java.lang.String)", "\tCALLEE: x.Y#z()", "CALLER: a.C#n(java.lang.String)", "\tCALLEE: a.B#m()", "\tCALLEE: a.B#m()"]
    calls = facts.call_graph(spark.createDataFrame([("f", *x) for x in enumerate(lines)], "path string, line long, value string"), ["line"], ["path"])
    assert {tuple(r)[1:] for r in calls.collect()} == {("a.B#m()", "static a.C#n(java.lang.String)"), ("a.B#m()", "x.Y#z()"), ("a.C#n(java.lang.String)", "a.B#m()")}
    ids = ["static foo.bar.Out.In#go(java.util.List, int[])", "Plain#<init>()", "a.b#c()"]
    got = [r[0].asDict() for r in spark.createDataFrame([(i,) for i in ids], "t string").select(facts.method_id(F.col("t"))).collect()]
    assert got[0] == {"package": ["foo", "bar"], "class_name": "Out$In", "method_name": "go", "is_static": True, "arg_types": ["List", "int[]"]}
    assert got[1] == {"package": [], "class_name": "Plain", "method_name": "<init>", "is_static": False, "arg_types": []} and got[2]["package"] == ["a", "b"]
    for name, text in {"src/A.java": "class A {}", "src/test/T.java": "class T {}", "src/package-info.java": "", "src/b/C.java": "class C {\n}", "note.txt": "x"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = facts.java_sources(spark, f"{tmp_path}/tree")
    assert {r["path"] for r in files.collect()} == {"src/A.java", "src/b/C.java"}
    assert [(r["line"], r["offset"]) for r in facts.lines(files).where("path = 'src/b/C.java'").orderBy("line").collect()] == [(0, 0), (1, 10)]
    (tmp_path / "run.log").write_text("1.5\n2.25\n\n")
    assert [(r["edit_no"], r["ms"]) for r in facts.latency_log(spark, f"{tmp_path}/run.log").orderBy("edit_no").collect()] == [(0, 1.5), (1, 2.25)]
    (tmp_path / "side").write_text("name : count\nalpha : 12\nbeta-2 : 7\n")
    assert {tuple(r) for r in facts.side_file(spark, f"{tmp_path}/side").collect()} == {("alpha", 12), ("beta-2", 7)}
    logs = spark.createDataFrame([("p", "x\n[STATS] 1 2\nSUMMARIES 9\n[STATS] cells: 3, deps: 44\nlast 5\n")], "path string, text string")
    assert facts.stats_lines(logs).first()["values"] == [1, 2, 3, 44, 5]


def test_ranks_and_formats(spark):
    rows = spark.createDataFrame([(float(i % 7), i) for i in range(100)], "ms double, id long").repartition(5)
    got = [r["id"] for r in analytics.ranked(rows, ["ms", "id"]).orderBy("rank").collect()]
    assert got == sorted(range(100), key=lambda i: (i % 7, i))
    shown = spark.createDataFrame([(0.001,), (0.05,), (12.34,)], "p double").select(analytics.shown_percent(F.col("p"))).collect()
    assert [r[0] for r in shown] == ["<0.01", "<0.1", "12.3"]


def test_diffs(spark):
    old, new = ({"a": "x\ny\nx", "b": "same", "c": "gone"}, {"a": "x\nz\nx\nx", "b": "same", "d": "come"})
    frames = [spark.createDataFrame(list(v.items()), "path string, text string") for v in (old, new)]
    changes = {tuple(r) for r in edits.file_changes(*frames, "path", "text").collect()}
    assert changes == {("a", "changed"), ("b", "same"), ("c", "deleted"), ("d", "added")}
    kinds = [r["kind"] for r in edits.diff_lines(*(edits.numbered_lines(f, "path", "text") for f in frames)).where("path = 'a'").collect()]
    assert sorted(kinds) == ["added", "added", "deleted", "shared", "shared"]


def test_front_end_forms():
    source = """package p.q; import java.util.*;
    /** doc */ @Deprecated public class A<T extends B> extends Base implements I, J {
        static final int K = 0x1F, L = 0b101; private List<Map<String, int[]>> f = null; int n = 3;
        A(int n) { this.n = n; super.go(); }
        { n = 4; }
        interface Inner { void x(); } enum E { ONE }
        static class In { long v(final int... xs) { return xs.length; } }
        <R> void g(String s) throws Exception { outer: for (;;) { while (true) { if (s == "}") continue outer; break outer; } } int[] a = new int[3]; a[0] += 2; (a)[1]++; Object o = (Object) s; boolean b = o instanceof String; for (String t : s.split(",")) { n--; } assert n > 0 : "no"; }
        int h() { return n > 0 ? -n : ~n; } void tried() { try { } finally { } } void bad() { Runnable r = () -> {}; } abstract void none();
    }"""
    p = java.Parser(source).source()
    assert {m["fn"] for m in p.methods} == {"p.q.A#<init>(int)", "p.q.A$In#v(int[])", "p.q.A$In#<init>()", "p.q.A#g(String)", "p.q.A#h()", "p.q.A#tried()", "p.q.A#<clinit>()"}
    assert p.hierarchy == [("p.q.A", "Base"), ("p.q.A", "I"), ("p.q.A", "J")] and ("p.q.A#bad", "lambda") in p.unsupported and ("p.q.A", "f", False) in p.fields and ("p.q.A", "K", True) in p.fields
    for fault in ("class {", "class A { int x = ; }", "class A { void f() { break; } }", "claß A {}"):
        with pytest.raises(java.SyntaxFault):
            java.Parser(fault).source()


def test_known_exit_states(spark):
    got = {(r["program"], r["variable"]): (r["lo"], r["hi"]) for r in examples.exit_states(spark).collect()}
    assert got == {(p, v): (a, b) for p, v, a, b in examples.EXITS}


def test_literals_and_operators():
    read = lambda text: java.Parser(f"class A {{ void f() {{ x = {text}; }} }}").source()
    value = lambda text: next(json.loads(x)["e"] for _, _, _, x in read(text).edges if json.loads(x).get("lhs") == "x")
    for text, number in {"052": 42.0, "0o17": 15.0, "0x2_Al": 42.0, "0b1_1": 3.0, "1_0": 10.0, "'\\t'": 9.0, "'\\''": 39.0, "'\\u0041'": 65.0, "'α'": 945.0}.items():
        assert value(text) == ["lit", number], text
    for text, number in {".3": 0.3, "2.": 2.0, "1e1f": 10.0, "6.5e+2": 650.0, "0f": 0.0}.items():
        assert value(text) == ["lit", number, "f"], text
    for op in (o for level in java.BINARY for o in level if o != "instanceof"):
        found = value(f"p {op} 2")
        assert found[1] in (op, "/~") and found[2:] == [["var", "p"], ["lit", 2.0]], op
    assert value("(p > q) ? p >> 1 : q")[0] == "var" and value("String::valueOf") == ["obj"]
    assert read("y; List<List<String>> z = null; z = a < b >> 2").methods and value("o instanceof Foo") == ["bin", "instanceof", ["var", "o"], ["type", "Foo"]]


def test_chains_of_calls_of_any_depth(spark):
    """Sixty methods that call one after the other keep their exact result; methods in a circle end."""
    chain = "".join(f"static int m{i}(int k) {{ return m{i + 1}(k + 1); }} " for i in range(60))
    source = f"class C {{ {chain} static int m60(int k) {{ return k; }} static int a(int n) {{ return b(n); }} static int b(int n) {{ return c(n); }} static int c(int n) {{ if (n > 0) return a(n - 1); return 4; }} static void main() {{ int r = m55(2); int s = a(5); }} }}"
    parsed = java.parse_sources(spark.createDataFrame([("p", source)], "path string, text string")).persist()
    edges, methods = (java.facts_of(parsed, k).withColumnRenamed("path", "program") for k in ("edge", "method"))
    cycles = {r["fn"] for r in analysis.call_cycles(analysis.call_targets(edges.withColumn("pos", F.xxhash64("src", "dst", "stmt")), methods)).collect()}
    assert cycles == {"C#a(int)", "C#b(int)", "C#c(int)"}
    cells = analysis.analyse(edges, methods, methods.where("method_name = 'main'").select("program", "fn", F.lit("{}").alias("entry")))
    state = json.loads(cells.where("fn = 'C#main()' AND loc = 1").first()["state"])
    assert state["r"] == [7.0, 7.0] and state.get("s", [4.0, 4.0]) == [4.0, 4.0]


EDITED = """class Up { static int top() { return 20; } static int idle() { return 1; }
    public static void main(String[] args) { int i = 0; while (i < top()) { i++; } int k = Up.idle(); } }"""


def snapshot(cells):
    return {(r["program"], r["fn"], r["entry"], r["loc"]): r["state"] for r in cells.collect()}


def test_edits_equal_from_scratch_and_keep_the_rest(spark, tmp_path):
    first = [("a", "Up.java", EDITED), ("b", "Payroll.java", examples.PROGRAMS["wages"]), ("a", "Bad.java", "class {")]
    second = [("a", "Up.java", EDITED.replace("20", "30")), ("a", "New.java", "class New { static int one() { return 1; } }")]
    frame = lambda rows: spark.createDataFrame(rows, SOURCES)
    kept = Analysis(spark, frame(first))
    demand = kept.methods().where("method_name = 'main'").select("program", "fn", F.lit("{}").alias("entry")).persist()
    before = snapshot(kept.query(demand))
    assert json.loads(before["a", "Up#main(String[])", "{}", 1])["i"][0] == 20.0
    assert kept.edit(frame(second)) == 2  # top and main, not idle, nor the other program
    after = snapshot(kept.query(demand))
    scratch = snapshot(Analysis(spark, frame([*second, first[1]]), reuse=False).query(demand))
    assert after == scratch and json.loads(after["a", "Up#main(String[])", "{}", 1])["i"][0] == 30.0
    everything = snapshot(Analysis(spark, frame([*second, first[1]])).query())
    assert {k: v for k, v in everything.items() if k in scratch} == scratch and len(everything) > len(scratch)
    seen = []
    (tmp_path / "edits").mkdir()
    rows = [(1, "a", "Up.java", EDITED.replace("20", "5")), (2, "a", "Up.java", EDITED.replace("20", "40")), (3, "b", "Payroll.java", None)]
    spark.createDataFrame(rows, EDITS).write.mode("append").parquet(f"{tmp_path}/edits/one")
    stream = spark.readStream.schema(EDITS).parquet(f"{tmp_path}/edits/*")
    only = demand.where("program = 'a'")
    follow(stream, kept, lambda cells, n: seen.append(snapshot(cells)), only, f"{tmp_path}/check").awaitTermination()
    assert json.loads(seen[-1]["a", "Up#main(String[])", "{}", 1])["i"][0] == 40.0 and not any(k[0] == "b" for k in seen[-1])


def test_stream_goes_on_after_a_lost_driver(spark, tmp_path):
    """A second driver that starts from the first sources answers from the edits that were applied before."""
    frame = lambda rows: spark.createDataFrame(rows, SOURCES)
    source = "class G {{ static void main() {{ int i = {}; }} }}"
    seen, other = [], "class H { static void main() { int h = 3; } }"

    def start():
        analysed = Analysis(spark, frame([("a", "G.java", source.format(1)), ("a", "H.java", other)]))
        demand = analysed.methods().where("method_name = 'main'").select("program", "fn", F.lit("{}").alias("entry")).persist()
        stream = spark.readStream.schema(EDITS).parquet(f"{tmp_path}/edits/*")
        follow(stream, analysed, lambda cells, n: seen.append(snapshot(cells)), demand, f"{tmp_path}/check").awaitTermination()

    for k, rows in enumerate(([(1, "a", "G.java", source.format(7))], [(2, "a", "H.java", other.replace("3", "8"))])):
        (tmp_path / "edits").mkdir(exist_ok=True)
        spark.createDataFrame(rows, EDITS).write.parquet(f"{tmp_path}/edits/{k}")
        start()
    assert len(seen) == 2 and json.loads(seen[-1]["a", "G#main()", "{}", 1])["i"] == [7.0, 7.0] and json.loads(seen[-1]["a", "H#main()", "{}", 1])["h"] == [8.0, 8.0]
