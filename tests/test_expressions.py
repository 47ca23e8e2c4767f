"""Flattened expressions against a plain evaluator of their trees: the same calls, stores and variables."""

from __future__ import annotations

import random

from conefix.operators import expressions

SCHEMA = "fn string, stmt string, node string, parent string, ord int, form string, value string"
OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: (a * b) % 1009}


class Machine:
    """Names, fields and cells, and a log of what is done to them."""

    def __init__(self):
        self.names = {v: i * 7 + 3 for i, v in enumerate("xyz")}
        self.heap, self.log = {}, []

    def value(self, form, value, args):
        if form == "binary":
            return OPS[value](*args)
        if form in ("field", "cell"):
            return self.heap.get((form, value, *args), 11)
        self.log.append((form, value, *args))
        return (sum(args) * 31 + len(self.log) * 17 + len(value or "")) % 1009

    def store(self, form, value, args):
        self.log.append(("store", form, value, *args))
        self.heap[(form, value, *args[:-1])] = args[-1]


class Tree:
    def __init__(self, stmt, seed):
        self.rng, self.stmt, self.rows = random.Random(seed), stmt, []
        self.root = self.make(None, 0, 0, False)

    def make(self, parent, order, depth, target):
        rng, node = self.rng, str(len(self.rows))
        forms = list(expressions.TARGETS) if target else [f for f in expressions.FORMS if f not in ("literal", "name")]
        form = rng.choice(forms) if depth < 4 and (target or rng.random() < 0.75) else "name" if target else rng.choice(["name", "name", "literal"])
        value = {"name": rng.choice("xyz"), "literal": str(rng.randint(0, 9)), "binary": rng.choice("+-*"), "unary": "-", "cast": "int", "instanceof": "T", "call": "f", "new": "C", "field": rng.choice("fg"), "assign": rng.choice([None, "+", "-"]), "before": rng.choice("+-"), "after": rng.choice("+-")}.get(form)
        self.rows.append(("m", self.stmt, node, parent, order, form, value))
        n = {"literal": 0, "name": 0, "binary": 2, "cell": 2, "assign": 2, "call": rng.randint(0, 3), "new": rng.randint(0, 2), "items": rng.randint(0, 3), "comma": rng.randint(1, 3), "array": rng.randint(1, 2)}.get(form, 1)
        return (form, value, [self.make(node, i, depth + 1, form in expressions.CHANGES and i == 0) for i in range(n)])

    def run(self, m, part):
        form, value, below = part
        if form == "literal":
            return int(value)
        if form == "name":
            return m.names[value]
        if form == "comma":
            return [self.run(m, p) for p in below][-1]
        if form not in expressions.CHANGES:
            return m.value(form, value, [self.run(m, p) for p in below])
        kind, name, inner = below[0]
        where = [self.run(m, p) for p in inner]
        old = None if form == "assign" and value is None else m.names[name] if kind == "name" else m.value(kind, name, where)
        right = self.run(m, below[1]) if form == "assign" else 1
        new = right if old is None else OPS[value](old, right)
        if kind == "name":
            m.names[name] = new
        else:
            m.store(kind, name, [*where, new])
        return old if form == "after" else new


def executed(steps):
    m, at = Machine(), {}

    def read(a):
        return at[a] if a[0] == "$" else m.names[a] if a in m.names else int(a)

    for _, _, target, form, value, args in steps:
        args = [read(a) for a in args]
        if form.startswith("store_"):
            m.store(form[6:], value, args)
        else:
            result = args[0] if form == "copy" else m.value(form, value, args)
            if target[0] == "$":
                at[target] = result
            else:
                m.names[target] = result
    return m


def test_random_expressions(spark):
    trees = [Tree(f"s{i}", i) for i in range(600)]
    # Statements with errors lose their steps, and only they.
    bad = [("m", "bad", "0", None, 0, "assign", None), ("m", "bad", "1", "0", 0, "literal", "3"), ("m", "bad", "2", "0", 1, "lambda", None)]
    steps, errors = expressions.flatten(spark.createDataFrame([r for t in trees for r in t.rows] + bad, SCHEMA))
    assert sorted(map(tuple, errors.collect())) == [("m", "bad", "1", "literal", "no target"), ("m", "bad", "2", "lambda", "unsupported")]
    found = {}
    for r in steps.collect():
        found.setdefault(r["stmt"], []).append((r["k"], r["part"], r["target"], r["form"], r["value"], r["args"]))
    assert "bad" not in found
    assert {r[5] for t in trees for r in t.rows} == set(expressions.FORMS)
    for tree in trees:
        want, got = Machine(), executed(sorted(found.get(tree.stmt, []), key=lambda s: s[:2]))
        tree.run(want, tree.root)
        assert (got.names, got.heap, got.log) == (want.names, want.heap, want.log), tree.rows


def test_names_are_held_only_where_they_change(spark):
    rows = [("m", "a", "0", None, 0, "binary", "+"), ("m", "a", "1", "0", 0, "name", "x"), ("m", "a", "2", "0", 1, "name", "y")]
    rows += [("m", "b", "0", None, 0, "binary", "+"), ("m", "b", "1", "0", 0, "name", "x"), ("m", "b", "2", "0", 1, "after", "+"), ("m", "b", "3", "2", 0, "name", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r["stmt"], r["k"], r["part"], r["target"], r["form"], r["args"]) for r in expressions.flatten(frame)[0].collect())
    assert found == [
        ("a", 3, 0, "$3", "binary", ["x", "y"]), ("b", 1, 0, "$1", "copy", ["x"]), ("b", 3, 0, "$3", "copy", ["x"]), ("b", 3, 1, "$3+", "binary", ["$3", "1"]), ("b", 3, 2, "x", "copy", ["$3+"]), ("b", 4, 0, "$4", "binary", ["$1", "$3"]),
    ]
    steps, errors = expressions.flatten(frame.where("false"))
    assert steps.isEmpty() and errors.isEmpty()
