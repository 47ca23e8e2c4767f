"""Lowered statement trees against a plain interpreter of the trees: both give the same traces."""

from __future__ import annotations

import random

from conefix.operators import dominators, statements

SCHEMA = "fn string, node string, parent string, ord int, role string, kind string, label string, target string, parts int, calls boolean"
LONGEST = 7


class Tree:
    """A random statement tree, and what it may do."""

    def __init__(self, fn, seed):
        self.rng, self.fn, self.rows, self.children = random.Random(seed), fn, [], {}
        self.make(None, 0, None, "block", 0, [], False, False)

    def make(self, parent, order, role, kind, depth, labels, loop, switch):
        rng = self.rng
        if kind is None:
            simple = ["expr", "expr", "local", "return", "throw", "empty", "assert"] + ["break"] * (loop or switch) + ["continue"] * loop
            kind = rng.choice(["block", "synchronized", "if", "while", "do", "for", "foreach", "switch", "try", "try", "try"] if depth < 4 and rng.random() < 0.62 else simple)
        node, label, target = str(len(self.rows)), None, None
        if kind in statements.LOOPS and rng.random() < 0.4:
            label = "L" + node
        if kind in ("block", "switch", "try") and depth and rng.random() < 0.2:
            label = "B" + node
        if kind == "break" and labels and rng.random() < 0.5:
            target = rng.choice(labels)
        if kind == "continue" and (own := [x for x in labels if x[0] == "L"]) and rng.random() < 0.5:
            target = rng.choice(own)
        calls = kind in ("expr", "local", "return") and rng.random() < 0.4
        self.rows.append((self.fn, node, parent, order, role, kind, label, target, rng.randint(1, 2) if kind == "local" else 1, calls))
        if parent is not None:
            self.children.setdefault(parent, []).append(node)
        inner = labels + ([label] if label else [])
        down = lambda i, r, k=None, lo=loop, sw=switch: self.make(node, i, r, k, depth + 1, inner, lo, sw)
        if kind in statements.SEQUENCES:
            for i in range(rng.randint(0, 3)):
                down(i, None)
        elif kind == "if":
            down(0, "then")
            if rng.random() < 0.5:
                down(1, "else")
        elif kind in statements.LOOPS:
            down(0, "body", None, True, switch)
        elif kind == "switch":
            n, default = rng.randint(0, 3), rng.randint(0, 3)
            for i in range(n):
                down(i, "default" if i == default else "case", None, loop, True)
        elif kind == "try":
            for i in range(rng.choice([0, 0, 1, 2])):
                self.rows.append((self.fn, f"{node}r{i}", node, i, "resource", "local", None, None, 1, rng.random() < 0.5))
                self.children.setdefault(node, []).append(f"{node}r{i}")
            down(0, "body")
            n = rng.randint(0, 2)
            for i in range(n):
                down(1 + i, "catch_all" if i == n - 1 and rng.random() < 0.4 else "catch")
            if rng.random() < 0.6:
                down(1 + n, "finally")
        return node

    # Traces are (events, outcome); the events of the others are compared up to LONGEST.

    def traces(self):
        self.by = {r[1]: r for r in self.rows}
        out = self.run("0")
        ends = {"next": "exit", "return": "exit"}
        return {(t, ends.get(o, o)) for t, o in out}

    @staticmethod
    def cut(found):
        return {(t[:LONGEST], "cut") if len(t) >= LONGEST else (t, o) for t, o in found}

    def then(self, found, way, more):
        """What ends by ``way`` goes on with ``more()``."""
        going = [t for t, o in found if o == way]
        rest = {(t, o) for t, o in found if o != way}
        if going:
            after = more()
            rest |= {(t + u, o) for t in going for u, o in after}
        return self.cut(rest)

    def step(self, node, op, throws=False, outcome="next"):
        return {(((node, op),), outcome)} | ({(((node, "throws"),), "throw")} if throws else set())

    def run(self, node):
        kind, label = self.by[node][5], self.by[node][6]
        out = self.form(node, kind)
        if label:
            out = {(t, "next" if o == f"break:{label}" else o) for t, o in out}
        return self.cut(out)

    def form(self, node, kind):
        target, parts, calls = self.by[node][7:]
        own = self.children.get(node, [])
        role = {self.by[c][4]: c for c in own}
        if kind == "empty":
            return {((), "next")}
        if kind == "expr":
            return self.step(node, "expr", calls)
        if kind == "assert":
            return self.step(node, "assume")
        if kind == "local":
            out = {((), "next")}
            for _ in range(parts):
                out = self.then(out, "next", lambda: self.step(node, "assign", calls))
            return out
        if kind == "return":
            return self.step(node, "return", calls, "return")
        if kind == "throw":
            return self.step(node, "throw", outcome="throw")
        if kind in ("break", "continue"):
            return {((), kind if target is None else f"{kind}:{target}")}
        if kind in statements.SEQUENCES:
            return self.sequence(own)
        if kind == "if":
            other = self.run(role["else"]) if "else" in role else {((), "next")}
            return self.then(self.step(node, "assume"), "next", lambda: self.run(role["then"])) | self.then(self.step(node, "refute"), "next", lambda: other)
        if kind in statements.LOOPS:
            return self.loop(node, kind, own[0])
        if kind == "switch":
            out = set()
            for i, c in enumerate(own):
                out |= self.then(self.step(c, self.by[c][4]), "next", lambda i=i: self.sequence(own[i:]))
            if "default" not in role:
                out |= self.step(node, "default")
            return {(t, "next" if o == "break" else o) for t, o in out}
        resources = [c for c in own if self.by[c][4] == "resource"]
        out = self.resources(node, resources, role["body"])
        catches = [c for c in own if self.by[c][4] in ("catch", "catch_all")]
        if catches:
            def caught():
                found = set()
                for c in catches:
                    found |= self.then(self.step(c, "caught"), "next", lambda c=c: self.run(c))
                return found if "catch_all" in role else found | self.step(node, "uncaught", outcome="throw")

            out = self.then(out, "throw", caught)
        return self.lastly(out, lambda: self.run(role["finally"])) if "finally" in role else out

    def lastly(self, found, end):
        out = {(t, o) for t, o in found if o == "cut"}
        after = end()
        return self.cut(out | {(t + u, o if p == "next" else p) for t, o in found if o != "cut" for u, p in after})

    def resources(self, node, names, body):
        if not names:
            return self.run(body)
        close = f"{node}~c{self.by[names[0]][3]}"
        inner = lambda: self.lastly(self.resources(node, names[1:], body), lambda: self.step(close, "expr", True))
        return self.then(self.run(names[0]), "next", inner)

    def sequence(self, nodes):
        out = {((), "next")}
        for c in nodes:
            out = self.then(out, "next", lambda c=c: self.run(c))
        return out

    def loop(self, node, kind, body):
        label = self.by[node][6]
        turn = {"continue"} | ({f"continue:{label}"} if label else set())
        once = {(t, "next" if o in turn else o) for t, o in self.run(body)}
        test = lambda: self.step(node, "assume") | {(((node, "refute"),), "left")}
        fetch = {"foreach": lambda: self.then(self.then(self.step(node, "has_next", True), "next", test), "next", lambda: self.step(node, "next", True))}.get(kind, test)
        out = {"for": lambda: self.step(node, "init"), "foreach": lambda: self.step(node, "iterator", True)}.get(kind, lambda: {((), "next")})()
        if kind == "do":
            out = self.then(out, "next", lambda: once)
        while any(o == "next" for _, o in out):
            out = self.then(self.then(out, "next", fetch), "next", lambda: once)
            if kind == "for":
                out = self.then(out, "next", lambda: self.step(node, "update"))
        return {(t, "next" if o in ("left", "break") else o) for t, o in out}


def walks(edges):
    """Traces of a graph from ``in``, without the steps that do nothing."""
    ahead = {}
    for src, dst, op, node in edges:
        ahead.setdefault(src, []).append((dst, () if op == "skip" else ((node, op),)))
    out, todo, seen = set(), [((), "in")], set()
    while todo:
        t, loc = todo.pop()
        if len(t) >= LONGEST or loc in ("exit", "throw"):
            out.add((t, loc if len(t) < LONGEST else "cut"))
            continue
        if (t, loc) not in seen:
            seen.add((t, loc))
            todo += [(t + e, d) for d, e in ahead.get(loc, ())]
    return out


def test_traces_of_random_trees(spark):
    trees = [Tree(f"m{i}", i) for i in range(250)]
    frame = spark.createDataFrame([r for t in trees for r in t.rows], SCHEMA)
    edges, errors = statements.lower(frame)
    assert errors.isEmpty()
    found = {}
    for r in edges.collect():
        found.setdefault(r["fn"], []).append((r["src"], r["dst"], r["op"], r["node"]))
    assert {r[5] for t in trees for r in t.rows} == set(statements.KINDS)
    for tree in trees:
        assert walks(found[tree.fn]) == tree.traces(), tree.fn


def method(fn, *rows):
    return [(fn, node, parent, order, role, kind, None, target, 1, calls) for node, parent, order, role, kind, target, calls in rows]


def test_shapes_of_graphs(spark):
    """Loops have one edge back, finally blocks a copy for each way, errors a row each."""
    root = ("0", None, 0, None, "block", None, False)
    loops = method(
        "loops", root, ("1", "0", 0, None, "while", None, False), ("2", "1", 0, "body", "block", None, False), ("3", "2", 0, None, "if", None, False), ("4", "3", 0, "then", "continue", None, False),
        ("5", "2", 1, None, "expr", None, True), ("6", "0", 1, None, "while", None, False), ("7", "6", 0, "body", "expr", None, False),
    )
    errors = method("errors", root, ("1", "0", 0, None, "break", None, False), ("2", "0", 1, None, "yield", None, False), ("3", "0", 2, None, "continue", "x", False))
    guard = [root, ("1", "0", 0, None, "while", None, False), ("2", "1", 0, "body", "try", None, False), ("3", "2", 0, "body", "block", None, False), ("4", "2", 1, "finally", "expr", None, False)]
    one = method("one", *guard, ("5", "3", 0, None, "return", None, False))
    two = method("two", *guard, ("5", "3", 0, None, "break", None, False), ("6", "3", 1, None, "return", None, False))
    edges, wrong = statements.lower(spark.createDataFrame(loops + errors + one + two, SCHEMA))
    back = dominators.back_edges(edges.where("fn = 'loops'"), spark.createDataFrame([("loops", "in")], "fn string, entry string"))
    assert {(r["src"], r["dst"]) for r in back.collect()} == {("1#l", "in"), ("7", "6")}
    assert sorted(map(tuple, wrong.collect())) == [("errors", "1", "break", "no target"), ("errors", "2", "yield", "unsupported"), ("errors", "3", "continue", "no target")]
    assert [tuple(r) for r in edges.where("fn = 'errors'").select("src", "dst", "op").collect()] == [("2", "3", "unsupported")]
    closing = edges.where("op = 'expr' AND fn IN ('one', 'two')").groupBy("fn").count()
    assert {r["fn"]: r["count"] for r in closing.collect()} == {"one": 2, "two": 3}


def test_no_statements(spark):
    edges, errors = statements.lower(spark.createDataFrame([], SCHEMA))
    assert edges.isEmpty() and errors.isEmpty()
