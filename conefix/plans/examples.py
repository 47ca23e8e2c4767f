"""Small programs whose exit states are known, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conefix.operators import graph
from conefix.plans import checks, shapes, statements
from conefix.plans.analysis import EXC, RET, analyse, bodies_of, demanded, located
from conefix.session import Scratch
from conefix.sources import facts, java, sinks

PROGRAMS = {
    "wages": """
        class Payroll {
            static class Tax { static int of(int gross) { return gross / 4; } }
            int rate, bonus;
            Payroll(int rate) { this.rate = rate; bonus = rate - 3; }
            int gross(int hours) { return hours * rate; }
            int net(int hours) { int g = gross(hours); return g - Tax.of(g) + bonus; }
            static void main() {
                Payroll p = new Payroll(12);
                int paid = p.net(9);
                int rest = p.rate % 5;
                int lo = 100; while (lo > 7) lo -= 4;
                int up = 0; do { up += 3; } while (up < 20);
            }
        }""",
    "shapes": """
        class Shape { int sides() { return 0; } int twice() { return 2 * sides(); } }
        class Tri extends Shape { int sides() { return 3; } }
        class Quad extends Tri { int sides() { return super.sides() + 1; } }
        class Use { static void main() {
            Shape s = new Quad(); Tri t = new Tri(); Quad q = new Quad();
            int any = s.sides(), some = t.sides(), one = q.sides(), both = s.twice();
        } }""",
    "ways": """
        class Ways {
            static int closed = 0;
            Ways() { }
            void close() { closed += 1; }
            static int risky(int n) { if (n > 5) throw new Oops(); return n * 3; }
            static void main() {
                int got = 0, after = 0, kind = 0, seen = 0, last = 9;
                closed = 0;
                try { got = risky(4); got = risky(8); } catch (Throwable t) { got += 100; } finally { after = 1; }
                try (Ways w = new Ways()) { seen = 2; }
                switch (got) { case 112: kind = 1; break; case 12: kind = 2; break; default: kind = 3; }
                outer: for (int i = 0; i < 6; i++) { for (int j = 0; j < 6; j++) { if (j == 3) continue outer; if (i == 2) break outer; seen = 7; } }
                for (int x : new int[] {2, 4}) last = 5;
                synchronized (Ways.class) { assert kind == 1; }
            }
        }""",
    "order": """
        class Order {
            static int n = 1;
            static int next() { n = n + 1; return n; }
            static void main() {
                n = 1; int i = 3;
                int a = i + i++, b = i++ * 2 + i, c = n + next() * n;
                int d = -7 / 2, e = 7 % 4, f = 40 >> 3, g = 5 << 2, k = (int) 9.8, m = '\\n', s = ~4;
                double h = 7 / 2.0;
                int[] xs = {5, 6, 7}; int u = 1; xs[u] = u++; int v = xs[1], w = xs.length >> 1;
                byte z = (byte) 300; int y = u < 5 && v == 1 ? 8 : 9;
            }
        }""",
    "boxes": """
        class Box {
            static int made = 0;
            int v = 2;
            { v = v + 5; made++; }
            Box() { v *= 3; }
            Box(int k) { this(); v -= k; }
            static int even(int n) { if (n <= 0) return 1; return odd(n - 1); }
            static int odd(int n) { if (n <= 0) return 0; return even(n - 1); }
            static int sum(int n) { if (n <= 0) return 0; int below = sum(n - 1); return below + 1; }
            static void main() {
                Box.made = 0; Box b = new Box(4);
                int q = b.v, c = Box.made, r = b instanceof Box ? 1 : 2, e = even(6), t = sum(3);
            }
        }""",
}

#: Accesses of main with what is known by hand: always, never or possibly within bounds.
ARRAYS = {
    "fixed": """
        class Fixed { public static void main(String[] args) {
            int[] xs = {3, 1, 2}; int a = xs[2]; int b = xs[3]; int i = 0; while (i < 3) { a = xs[i]; i++; }
        } }""",
    "sized": """
        class Sized { static void main(int n) { int[] xs = new int[n]; int i = 0; while (i < xs.length) { xs[i] = i; i++; } } }""",
}
ACCESSES = [("fixed", '["lit", 2.0]', True), ("fixed", '["lit", 3.0]', False), ("fixed", '["var", "i"]', True), ("sized", '["var", "i"]', True)]

NULLS = {
    "handled": """
        class Node { Node next; static Node same(Node a) { return a; }
            static void main(Node p) { Node o = new Node(); Node n = null; Node r = same(o); r.next = o;
                if (p != null) { p.next = o; } Node q = p.next; n.next = o; Node gone = q.next; } }""",
}
#: What main uses as an object; nothing comes after the use of null.
USES = [("handled", "r", True), ("handled", "p", True), ("handled", "p", None), ("handled", "n", False)]

#: Bounds of main's variables at its exit, worked out by hand; a missing bound is infinite.
EXITS = [
    ("wages", "paid", 90.0, 90.0),
    ("wages", "rest", 0.0, 5.0),
    ("wages", "p.rate", 12.0, 12.0),
    ("wages", "p.bonus", 9.0, 9.0),
    ("wages", "lo", None, 7.0),
    ("wages", "up", 20.0, None),
    ("shapes", "any", 0.0, 4.0),
    ("shapes", "some", 3.0, 4.0),
    ("shapes", "one", 4.0, 4.0),
    ("shapes", "both", 0.0, 8.0),
    ("ways", "got", 112.0, 112.0),
    ("ways", "after", 1.0, 1.0),
    ("ways", "kind", 1.0, 1.0),
    ("ways", "seen", 2.0, 7.0),
    ("ways", "last", 5.0, 9.0),
    ("ways", "i", 2.0, None),
    ("order", "Order.n", 2.0, 2.0),
    ("order", "i", 5.0, 5.0),
    ("order", "a", 6.0, 6.0),
    ("order", "b", 13.0, 13.0),
    ("order", "c", 5.0, 5.0),
    ("order", "d", -3.0, -3.0),
    ("order", "e", 0.0, 4.0),
    ("order", "f", 5.0, 5.0),
    ("order", "g", 20.0, 20.0),
    ("order", "h", 3.5, 3.5),
    ("order", "k", 9.0, 9.0),
    ("order", "m", 10.0, 10.0),
    ("order", "s", -5.0, -5.0),
    ("order", "u", 2.0, 2.0),
    ("order", "v", 1.0, 1.0),
    ("order", "w", 1.0, 1.0),
    ("order", "y", 8.0, 8.0),
    ("order", "z", -128.0, 127.0),
    ("boxes", "q", 17.0, 17.0),
    ("boxes", "c", 1.0, 1.0),
    ("boxes", "r", 1.0, 2.0),
    ("boxes", "t", 1.0, None),
]

def _facts(spark: SparkSession, programs: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, methods, the class hierarchy and the demand of the mains."""
    parsed = java.parse_sources(spark.createDataFrame(list(programs.items()), "path string, text string")).persist()
    edges, methods, parents = (java.facts_of(parsed, kind).withColumnRenamed("path", "program") for kind in ("edge", "method", "parent"))
    return edges, methods, parents, methods.where("method_name = 'main'").select("program", "fn", F.lit("{}").alias("entry"))


def array_checks(spark: SparkSession) -> DataFrame:
    """``(program, index, safe)`` of main's array accesses, by intervals and octagons together."""
    edges, methods, parents, demand = _facts(spark, ARRAYS)
    found = checks.bounds_checks(edges, analyse(edges, methods, demand, domain="octagon", hierarchy=parents), "octagon")
    return found.select("program", "index", "safe").distinct()


def null_checks(spark: SparkSession) -> DataFrame:
    """``(program, variable, safe)`` of what main uses as an object, without temporaries."""
    edges, methods, parents, demand = _facts(spark, NULLS)
    found = checks.null_uses(edges, analyse(edges, methods, demand, domain="nullness", hierarchy=parents))
    return found.where("fn LIKE '%#main(%' AND NOT startswith(variable, '$')").select("program", "variable", "safe").distinct()


def exit_states(spark: SparkSession) -> DataFrame:
    """``(program, variable, lo, hi)`` of main's own variables at its exit, without open ones."""
    edges, methods, parents, demand = _facts(spark, PROGRAMS)
    cells = analyse(edges, methods, demand, hierarchy=parents)
    rows = cells.where("loc = 1 AND fn LIKE '%#main(%' AND state IS NOT NULL").select("program", F.explode(F.from_json("state", "map<string, array<double>>", {"allowNonNumericNumbers": "true"})).alias("variable", "b"))
    finite = lambda i: F.when(~F.col("b")[i].isin(float("inf"), float("-inf")), F.col("b")[i])
    return rows.where(~F.col("variable").startswith("$") & ~F.col("variable").isin(RET, EXC) & ~F.col("variable").contains(".#")).select("program", "variable", finite(0).alias("lo"), finite(1).alias("hi"))


#: Two versions of a program, and the edits between them.
VERSIONS = (
    "class V { int a(int n) { int x = 1; if (n > 0) { x = n; x++; } else { x = 2; } return x; } void b() { go(); } int d() { return 1; } static class W { void c() { while (on()) { step(); stop(); } } } }",
    "class V { int a(int n) { int x = 1; log(x); if (n > 0) { x = n; } else { x = 3; } return x; } void b() { go(); } int e() { return 1; } static class W { void c() { while (on()) { stop(); step(); } } } }",
)
CHANGES = [
    ("V#a/1", "add_statements", "1", 0, 1),
    ("V#a/1", "delete_statements", "1.0/1", 1, 0),
    ("V#a/1", "modify_statements", "1.1/0", 1, 1),
    ("V#d/0", "delete_function", "", None, None),
    ("V#e/0", "add_function", "", None, None),
    ("V$W#c/0", "delete_statements", "0.0/0", 1, 0),
    ("V$W#c/0", "add_statements", "0.0/2", 0, 1),
]

#: A method that two callers reach with different arguments; its parameter at the entry and exit, without an entry state given.
CALLED = "class L { static int half(int k) { return k / 2; } static int low() { return half(4); } static int high() { return half(31); } static void main() { int a = low(); int b = high(); } }"
PLACES = [("k", 0, 4.0, 4.0), ("k", 0, 31.0, 31.0), ("RET_VAR", 1, 2.0, 2.0), ("RET_VAR", 1, 15.0, 15.0), ("k", 1, 4.0, 4.0), ("k", 1, 31.0, 31.0)]

#: Forms that make methods unsupported, with their numbers.
ODD = "class O { void a() { Runnable r = () -> { }; } void b() { f(x -> x); } int c(int n) { return switch (n) { default -> 1; }; } Object d() { return new Object() { }; } interface I { } }"
FORMS = [("lambda", 2), ("switch expression", 1), ("anonymous class", 1), ("interface declaration", 1)]

#: Numbers of the solved tables of "wages": contexts, dependencies, methods, contexts that ask for themselves.
STATS = (5, 4, 5, 0)

#: Nested loops by edges, their back edges, and the heads around each location.
LOOPS = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 3), (4, 5), (5, 1), (2, 6), (1, 7)]
AROUND = [(2, "1"), (3, "1"), (4, "1,3"), (5, "1")]


def statement_edits(spark: SparkSession) -> DataFrame:
    """``(method, kind, place, old, new)`` between the two versions."""
    frame = lambda text: spark.createDataFrame([("v", text)], "program string, text string")
    return statements.statement_edits(*map(frame, VERSIONS)).select("method", "kind", "place", "old", "new")


def _bounds(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.select(*keys, F.explode(F.from_json("state", "map<string, array<double>>", {"allowNonNumericNumbers": "true"})).alias("variable", "b")).select(*keys, "variable", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))


def located_states(spark: SparkSession) -> DataFrame:
    """``(variable, loc, lo, hi)`` at the entry and exit of a method under all entries that its callers give."""
    edges, methods, parents, _ = _facts(spark, {"l": CALLED})
    scratch = Scratch(spark, "located")
    bodies = scratch.save(bodies_of(edges, methods, hierarchy=parents), "bodies")
    places = methods.where("method_name = 'half'").select("program", "fn", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("loc"))
    return _bounds(located(bodies, places, scratch), "loc").where("NOT startswith(variable, '$')").select("variable", "loc", "lo", "hi").distinct()


def form_counts(spark: SparkSession) -> DataFrame:
    parsed = java.parse_sources(spark.createDataFrame([("o", ODD)], "path string, text string"))
    return facts.form_counts(java.facts_of(parsed, "unsupported"))


def solved_stats(spark: SparkSession) -> DataFrame:
    """The statistics of a solved program."""
    edges, methods, parents, demand = _facts(spark, {"wages": PROGRAMS["wages"]})
    scratch = Scratch(spark, "stats")
    bodies = scratch.save(bodies_of(edges, methods, hierarchy=parents), "bodies")
    return sinks.stats(demanded(bodies, demand, scratch), bodies).select("contexts", "dependencies", "methods", "self_loops")


def heads_around(spark: SparkSession) -> DataFrame:
    """``(loc, heads)`` of the nested loops, by back edges of a depth-first search."""
    edges = spark.createDataFrame([("f", a, b) for a, b in LOOPS], "fn_id string, src long, dst long")
    back = graph.back_edges(edges.withColumn("entry", F.lit(0)))
    return graph.containing_heads(edges, back).select("loc", F.array_join(F.transform("heads", lambda h: h.cast("string")), ",").alias("heads"))


#: Programs over lists, with the entry states of their methods, and what their results are at the exit.
LISTS = """
class Link { int key; Link next; }
class Lists {
    static Link concat(Link left, Link right) {
        if (left == null) return right;
        Link end = left;
        while (end.next != null) end = end.next;
        end.next = right;
        return left;
    }
    static Link turned(Link rest) {
        Link done = null;
        while (rest != null) { Link after = rest.next; rest.next = done; done = rest; rest = after; }
        return done;
    }
    static Link made(int n) {
        Link top = null;
        for (int i = 0; i < n; i++) { Link one = new Link(); one.next = top; top = one; }
        return top;
    }
    static Link last(Link from) { Link at = from; while (at.next != null) at = at.next; return at; }
    static Link knot(Link from) { from.next = from; return from; }
    static Link pair() { Link a = new Link(); a.next = new Link(); return a; }
    static Link behind() { Link two = pair(); return two.next.next; }
    static Link twice(int n) { return turned(made(n)); }
}"""
_ONE = '{"env": {"%s": 1}, "next": {"1": ["seg", 0]}}'
LIST_ENTRIES = {
    "concat": '{"env": {"left": 1, "right": 2}, "next": {"1": ["seg", 0], "2": ["seg", 0]}}',
    "turned": _ONE % "rest", "made": "{}", "last": _ONE % "from", "knot": _ONE % "from", "pair": "{}", "behind": "{}", "twice": "{}",
}
SHAPES_FOUND = [("concat", "list"), ("turned", "list"), ("made", "list"), ("last", "list, not empty"), ("knot", "unknown"), ("pair", "list, not empty"), ("behind", "null"), ("twice", "list")]


def list_shapes(spark: SparkSession) -> DataFrame:
    """``(method, shape)``: what the methods over lists give back."""
    edges, methods, parents, _ = _facts(spark, {"lists": LISTS})
    entries = spark.createDataFrame(list(LIST_ENTRIES.items()), "method_name string, entry string")
    asked = methods.where("class_name = 'Lists'").select("program", "fn", "method_name").join(F.broadcast(entries), "method_name")
    cells = analyse(edges, methods, asked.select("program", "fn", "entry"), domain="shape", hierarchy=parents)
    found = cells.where("loc = 1").join(asked, ["program", "fn", "entry"])
    told = F.pandas_udf(lambda states: states.map(lambda s: shapes.described(shapes.load(s), RET)), "string")
    return found.select(F.col("method_name").alias("method"), told("state").alias("shape"))
