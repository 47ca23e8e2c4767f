"""Front end and domains without Spark: every state of a concrete run lies in the cell of its location."""

from __future__ import annotations

import json
import math
import operator
import random

import pytest

from conefix.plans import analysis, examples
from conefix.plans.domains import EITHER, NULL, OBJECT
from conefix.sources import java
from conefix.sources.java import EXC, RET


class Program:
    def __init__(self, source: str):
        p = java.Parser(source).source()
        assert not p.unsupported
        self.methods = {m["fn"]: m for m in p.methods}
        self.edges = {f: [(a, b, json.loads(x)) for g, a, b, x in p.edges if g == f] for f in self.methods}

    def targets(self, stmt: dict) -> list[dict]:
        named = [m for m in self.methods.values() if m["method_name"] == stmt["name"] and len(m["formals"]) == len(stmt["args"])]
        return [m for m in named if stmt["cls"] is None or m["class_name"].split("$")[-1] == stmt["cls"].split("$")[-1]]

    def main(self) -> str:
        return next(f for f, m in self.methods.items() if m["method_name"] == "main")

    def solve(self, name: str) -> dict[tuple[str, str], dict]:
        """All contexts that main needs, by rounds over everything."""
        d, todo, exits, out = analysis.domain_named(name), {(self.main(), "{}")}, {}, {}
        for _ in range(60):
            found, before = set(todo), {k: tuple(map(d.dump, v)) for k, v in exits.items()}
            for fn, entry in sorted(todo):
                callees = {i: [{"fn": m["fn"], "formals": m["formals"], "varargs": m["varargs"], "mutual": False} for m in self.targets(x)] for i, (_, _, x) in enumerate(self.edges[fn]) if x["k"] in ("call", "xcall")}
                cells, asked = analysis.solve(fn, self.edges[fn], d.load(entry), callees, exits, d)
                out[fn, entry] = cells
                exits[analysis.context_of(fn, entry)] = (cells.get(1), cells.get(2))
                found |= {(f, t) for _, f, t in asked}
            if found == todo and before == {k: tuple(map(d.dump, v)) for k, v in exits.items()}:
                return out
            todo = found
        raise AssertionError("no fixpoint")

    def exits(self, name: str) -> tuple[dict | None, dict | None]:
        cells = self.solve(name)[self.main(), "{}"]
        return cells.get(1), cells.get(2)


class Stopped(Exception):
    """A division by zero ends a run."""


def divided(a: float, b: float, op: str) -> float:
    if not b:
        raise Stopped
    return math.fmod(a, b) if op == "%" else float(math.trunc(a / b))


OPS = {"//": lambda a, b: divided(a, b, "//"), "%": lambda a, b: divided(a, b, "%"), ">>": lambda a, b: math.floor(a / 2 ** b), "<<": lambda a, b: a * 2 ** b, "+": operator.add, "-": operator.sub, "*": operator.mul, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "&&": lambda a, b: a and b, "||": lambda a, b: a or b}


def value(e: list, env: dict) -> float | None:
    if e[0] == "lit":
        return e[1]
    if e[0] == "var":
        return env[e[1]]
    if e[0] == "un":
        v = value(e[2], env)
        return float(not v) if e[1] == "!" else v if e[1][0] == "(" else -v
    return float(OPS[e[1]](value(e[2], env), value(e[3], env)))


def walk(edges: list, env: dict, steps: int = 400) -> list[tuple[int, dict]]:
    """The locations and variables of one run of a method without calls."""
    at, seen = 0, [(0, dict(env))]
    for _ in range(steps):
        for src, dst, stmt in edges:
            try:
                if src != at or stmt["k"] == "assume" and not value(stmt["e"], env):
                    continue
                if stmt["k"] == "assign":
                    env = env | {stmt["lhs"]: value(stmt["e"], env)}
            except Stopped:
                return seen
            if any(abs(v) > 1e9 for v in env.values() if v is not None):
                return seen  # beyond what a double holds exactly
            at = dst
            seen.append((at, dict(env)))
            break
        else:
            return seen
    return seen


def random_body(rng: random.Random, depth: int = 0) -> str:
    names = "abcd"
    operand = lambda: rng.choice([*names, str(rng.randrange(-3, 9))])
    test = lambda: f"{operand()} {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {operand()}"
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["set", "set", "if", "while", "switch", "try", "pick"] if depth < 2 else ["set", "pick"])
        inner = lambda: random_body(rng, depth + 1)
        if kind == "set":
            last = rng.choice([f"{rng.choice('+-*/%')} {operand()}", f"{rng.choice(['>>', '<<'])} {rng.randrange(3)}", f"{rng.choice('+-/')} {rng.choice(names)}++", f"+ ({rng.choice(names)} = {operand()})"])
            out.append(f"{rng.choice(names)} {rng.choice(['=', '+=', '-=', '/='])} {operand()} {last};")
        elif kind == "pick":
            out.append(f"{rng.choice(names)} = {test()} && !({test()}) || {test()} ? {operand()} : {operand()};")
        elif kind == "if":
            out.append(f"if ({test()} {rng.choice(['&&', '||'])} {test()}) {{ {inner()} }} else {{ {inner()} }}")
        elif kind == "while":
            out.append(f"while ({test()}) {{ {inner()} {rng.choice(['', 'if (a > b) break;', 'if (c == 2) continue;'])} {rng.choice(names)}++; }}")
        elif kind == "switch":
            out.append(f"switch ({operand()}) {{ case 1: {inner()} break; case 2: {inner()} case 3, 4: {inner()} default: {inner()} }}")
        else:
            out.append(f"try {{ {inner()} if ({test()}) throw a; {inner()} }} {rng.choice(['', 'catch (E e) { ' + inner() + ' }', 'catch (Throwable e) { ' + inner() + ' }'])} finally {{ {inner()} }}")
    return " ".join(out)


@pytest.mark.parametrize("name", ["interval", "octagon"])
def test_runs_stay_in_their_cells(name):
    rng = random.Random(11)
    for _ in range(60 if name == "interval" else 20):
        start = [rng.randrange(-2, 5) for _ in range(4)]
        program = Program(f"class P {{ static void main() {{ int a = {start[0]}, b = {start[1]}, c = {start[2]}, d = {start[3]}; {random_body(rng)} }} }}")
        cells = program.solve(name)[program.main(), "{}"]
        for loc, env in walk(program.edges[program.main()], {}):
            state = cells[loc]
            box = state if name == "interval" else state.sharp()
            for variable, (lo, hi) in box.items():
                assert lo - 1e-6 <= env[variable] <= hi + 1e-6
            for v1, s1, v2, s2, bound in state.oct.rows() if name == "octagon" else ():
                assert s1 * env[v1] + s2 * env[v2] <= bound + 1e-6


def test_exceptions_go_to_their_handlers():
    source = """class T {
        static int f(int k) { if (k > 3) throw new E(k); return k; }
        static void main() { int a = 0, b = 0, c = 0; try { a = f(2); b = f(7); c = 1; } catch (E e) { b = 5; } finally { c += 10; } } }"""
    back, thrown = Program(source).exits("interval")
    assert [back[v] for v in "abc"] == [(2.0, 2.0), (5.0, 5.0), (10.0, 10.0)] and thrown["b"] == (0.0, 0.0) and thrown["c"] == (10.0, 10.0)
    back, thrown = Program(source.replace("E e", "Throwable e")).exits("interval")
    assert back["b"] == (5.0, 5.0) and thrown is None
    closing = "class R { static int n = 0; R() {} void close() { n++; } int get() { return 4; } } class T { static int main() { R.n = 0; try (R r = new R(); R q = new R()) { return r.get(); } } }"
    back, thrown = Program(closing).exits("interval")
    assert back[RET] == (4.0, 4.0) and back["R.n"] == (2.0, 2.0) and thrown is None
    leave = "class T { static int main(int p) { int x = 0; for (int i = 0; i < 9; i++) { try { if (i == p) break; return 7; } finally { x = 50; } } return x; } }"
    assert Program(leave).exits("interval")[0][RET] == (7.0, 50.0)


def test_switches_arrays_and_initializers():
    source = """class T { static int k = 2; int f = 1; { f += 4; } T() {} T(int n) { this(); f = f + n; }
        static void main() { int a = 2, r = 0; switch (a) { case 1: r = 1; break; case 2: r = 2; case 3: r += 10; break; default: r = 99; }
        int q = 0; switch (a) { case 1, 2 -> q = 7; default -> q = 8; } block: { if (a == 2) break block; q = 0; }
        int[] xs = {4, 5, 6}; int[] ys = xs; ys[1] = 9; int s = xs[1] + xs.length; int n = new int[a].length; T t = new T(3); int f = t.f; } }"""
    found = Program(source).exits("interval")[0]
    assert [found[v] for v in ("r", "q", "n", "f")] == [(12.0, 12.0), (7.0, 7.0), (2.0, 2.0), (8.0, 8.0)]
    assert found["s"] == (8.0, 12.0)  # ys may be xs, and is
    program = Program(source)
    d = analysis.INTERVALS
    cells, _ = analysis.solve("T#<clinit>()", program.edges["T#<clinit>()"], {}, {}, {}, d)
    assert cells[1]["T.k"] == (2.0, 2.0)


def test_short_circuits_run_the_right_side_only_where_needed():
    source = "class T { static int n = 0; static boolean hit() { n += 1; return true; } static void main(int p) { T.n = 0; boolean b = p > 3 && hit(); int q = 1; if (p > 0 && hit()) q = p; } }"
    found = Program(source).exits("interval")[0]
    assert found["T.n"] == (0.0, 2.0) and found["q"] == (pytest.approx(0.0, abs=1e-9), math.inf)


def test_nullness():
    source = """class T { T next; static T id(T a) { return a; } void set(T x) { next = x; }
        static void main(T p) { T n = null; T o = new T(); T r = id(o); T z = id(n); T both = p == null ? o : null; o.set(r); T back = o.next; o.set(null); T gone = o.next;
        if (p != null && p.next != null) { T k = p.next; } T y = p.next; String s = "x"; int[] xs = {1}; } }"""
    found = Program(source).exits("nullness")[0]
    assert [found.get(v, EITHER) for v in ("n", "o", "r", "z", "both", "p", "s", "xs")] == [NULL, OBJECT, OBJECT, NULL, EITHER, OBJECT, OBJECT, OBJECT]
    assert found.get("back") == OBJECT and found.get("gone") == NULL
    assert Program("class T { T next; static void main() { T n = null; n.next = n; } }").exits("nullness") == (None, None)
    assert Program("class T { void go() { } static void main() { T n = null; try { n.go(); } catch (Throwable t) { n = t; } } }").exits("nullness") == (None, None)
    caught = Program("class T { static void bad() { throw new E(); } static void main() { T n = null; try { bad(); } catch (E e) { n = e; } } }").exits("nullness")
    assert caught[0]["n"] == OBJECT and caught[1][EXC] == OBJECT


def test_checks_of_statements(spark):
    assert {tuple(r) for r in examples.array_checks(spark).collect()} == set(examples.ACCESSES)
    assert {tuple(r) for r in examples.null_checks(spark).collect()} == set(examples.USES)


def test_octagons_relate_variables():
    source = "class T { static int less(int u, int v) { return v - u; } static void main(int n) { int m = n + 2; int d = m - n; int e = less(n, m); int i = 0, j = 5; while (i < 10) { i++; j++; } } }"
    found = Program(source).exits("octagon")[0]
    rows = {tuple(r[:4]): r[4] for r in found.oct.rows()}
    assert rows["i", -1, "j", 1] == 5.0 and rows["i", 1, "j", -1] == -5.0
    text = analysis.domain_named("octagon").dump(found)
    assert analysis.domain_named("octagon").dump(analysis.domain_named("octagon").load(text)) == text
