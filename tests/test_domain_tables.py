"""Octagons, calls, heaps and literals as tables, against plain loops."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from conefix.functions import interval
from conefix.functions.interval import Itv
from conefix.operators import calls, octagons


def shortest(entries, n):
    """Closed matrix of some bounds, or None where they contradict one another."""
    d = [[0.0 if i == j else math.inf for j in range(2 * n)] for i in range(2 * n)]
    for i, j, c in entries:
        d[i][j] = min(d[i][j], c)
    for k in range(2 * n):
        for i in range(2 * n):
            for j in range(2 * n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    if any(d[i][i] < 0 for i in range(2 * n)):
        return None
    return {(i, j): min(d[i][j], (d[i][i ^ 1] + d[j ^ 1][j]) / 2) for i in range(2 * n) for j in range(2 * n) if i != j}


def random_octagon(rng, n):
    out = []
    for _ in range(rng.randrange(1, 9)):
        i, j, c = rng.randrange(2 * n), rng.randrange(2 * n), float(rng.randrange(-4, 14))
        if i != j:
            out += [(i, j, c), (j ^ 1, i ^ 1, c)]  # both forms of one bound
    return out


SCHEMA = "g string, i int, j int, c double"


def frame(spark, states):
    return spark.createDataFrame([(g, *e) for g, entries in states.items() for e in entries], SCHEMA).repartition(2)


def as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], {})[r["i"], r["j"]] = r["c"]
    return out


def test_closure_equals_shortest_paths(spark):
    rng = random.Random(11)
    states = {f"s{k}": random_octagon(rng, 3) for k in range(60)}
    states = {g: e for g, e in states.items() if e}
    states["bad"] = [(0, 1, 2.0), (1, 0, -4.0)]
    closed = octagons.closed(frame(spark, states), ["g"]).persist()
    empty = {r["g"]: r["empty"] for r in octagons.is_empty(closed, ["g"]).collect()}
    got, contradictions = as_dict(closed), 0
    for g, entries in states.items():
        want = shortest(entries, 3)
        contradictions += want is None
        assert empty[g] == (want is None), g
        if want is not None:
            assert got[g] == {k: c for k, c in want.items() if c < math.inf}, g
    assert contradictions > 3 and len(states) - contradictions > 20


def test_lattice_of_octagons(spark):
    rng = random.Random(12)
    a, b = ({k: e for k in "uvwxyz" if shortest(e := random_octagon(rng, 2), 2) is not None and e} for _ in range(2))
    x, y = (octagons.closed(frame(spark, s), ["g"]).persist() for s in (a, b))
    both = [g for g in a if g in b]
    joined, widened, met = (as_dict(f(x, y, ["g"])) for f in (octagons.join, octagons.widen, octagons.meet))
    da, db = as_dict(x), as_dict(y)
    for g in both:
        assert joined.get(g, {}) == {k: max(c, db[g][k]) for k, c in da[g].items() if k in db[g]}
        assert widened.get(g, {}) == {k: c for k, c in da[g].items() if k in db[g] and db[g][k] <= c}
        assert met[g] == {k: min(da[g].get(k, math.inf), db[g].get(k, math.inf)) for k in {*da[g], *db[g]}}
    holds = {r["g"]: r["implies"] for r in octagons.implies(x, octagons.join(x, y, ["g"]), ["g"]).collect()}
    assert len(both) > 2 and all(holds.values())


def test_octagons_around_points_hold_them_and_bound_sums(spark):
    rng = random.Random(13)
    points = [(g, float(rng.randrange(9)), float(rng.randrange(9))) for g in ("a", "b") for _ in range(12)] + [("c", None, 1.0)]
    held = octagons.from_points(spark.createDataFrame(points, "g string, x double, y double"), ["g"], ["x", "y"]).persist()
    own = {g: [p for p in points if p[0] == g] for g in ("a", "b")}
    for args, value in (((0,), lambda p: p[1]), ((1,), lambda p: p[2]), ((0, 1), lambda p: p[1] + p[2]), ((0, 1, -1), lambda p: p[1] - p[2])):
        got = {r["g"]: (r["lo"], r["hi"]) for r in octagons.bounds(held, ["g"], *args).collect()}
        assert all(got[g] == (min(map(value, own[g])), max(map(value, own[g]))) for g in own)
    below = octagons.closed(octagons.meet(held, held.select("g").distinct().select("g", F.inline(octagons.assumed(0, 1, F.lit(2.0)))), ["g"]), ["g"])
    got = {r["g"]: r["hi"] for r in octagons.bounds(below, ["g"], 0).collect()}
    assert all(got[g] <= 2.0 for g in own)


def test_calls_with_variable_arguments(spark):
    links = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f"), (3, "g")], "site long, callee string")
    actuals = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 3.0), (1, 2, 4.0, 9.0), (2, 0, 5.0, 5.0), (3, 0, 7.0, 7.0)], "site long, pos int, lo double, hi double")
    formals = spark.createDataFrame([("f", 0, "a", False), ("f", 1, "r", True), ("g", 0, "b", False), ("g", 1, "c", False)], "callee string, pos int, name string, rest boolean")
    got = sorted(map(tuple, calls.bind(links, actuals, formals).collect()))
    assert got == sorted([(1, "f", "a", 1.0, 2.0), (1, "f", "r[0]", 3.0, 3.0), (1, "f", "r[1]", 4.0, 9.0), (1, "f", "r.#", 2.0, 2.0), (2, "f", "a", 5.0, 5.0), (2, "f", "r.#", 0.0, 0.0), (3, "f", "a", 7.0, 7.0), (3, "f", "r.#", 0.0, 0.0), (3, "g", "b", 7.0, 7.0)])
    exits = spark.createDataFrame([("f", 1.0, 4.0)], "callee string, lo double, hi double")
    assert sorted(map(tuple, calls.returned(links, exits).collect())) == [(1, 1.0, 4.0), (2, 1.0, 4.0), (3, None, None)]


def test_stores_through_aliases(spark):
    heap = spark.createDataFrame([(1, "n", 0.0, 1.0), (2, "n", 0.0, 1.0), (3, "n", 5.0, 6.0), (1, "m", 2.0, 2.0)], "address long, field string, lo double, hi double")
    points_to = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3), ("r", 4)], "var string, address long")
    writes = spark.createDataFrame([("p", "n", 9.0, 9.0), ("q", "n", -3.0, 2.0), ("r", "n", 8.0, 8.0), ("unknown", "n", 0.0, 99.0)], "var string, field string, lo double, hi double")
    assert sorted(map(tuple, calls.store(heap, points_to, writes).collect())) == [(1, "m", 2.0, 2.0), (1, "n", 9.0, 9.0), (2, "n", -3.0, 2.0), (3, "n", -3.0, 6.0), (4, "n", 8.0, 8.0)]


def test_literals_and_bits(spark):
    texts = {"0": 0.0, "42L": 42.0, "1_000": 1000.0, "0x1F": 31.0, "0b101": 5.0, "017": 15.0, "1.5e3": 1500.0, ".5f": 0.5, "2d": 2.0, "'a'": 97.0, "true": 1.0, "FALSE": 0.0, '"x"': None, "null": None, "": None, "09x": None}
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", interval.literal(F.col("t")).alias("v")).collect()}
    assert got == texts
    spans = [(float(a), float(b)) for a in range(-2, 6) for b in range(a, 6)]
    pairs = spark.createDataFrame([(*x, *y) for x in spans for y in spans if (x[0] + y[1]) % 3 == 0], "a double, b double, c double, d double")
    x, y = Itv.of("a", "b"), Itv.of("c", "d")
    both, either = interval.bitwise_and(x, y), interval.bitwise_or(x, y)
    for r in pairs.select("*", both.lo.alias("l"), both.hi.alias("h"), either.lo.alias("ol"), either.hi.alias("oh")).collect():
        for p in range(int(r["a"]), int(r["b"]) + 1):
            for q in range(int(r["c"]), int(r["d"]) + 1):
                assert r["l"] <= p & q <= r["h"] and r["ol"] <= p | q <= r["oh"]
