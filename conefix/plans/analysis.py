"""Demand-driven analysis over the facts of many programs.

A cell is the state at a location of a method under an entry state (its context).
The driver holds only the loop: each round solves the demanded (method, context)
pairs whose inputs are new, as one grouped plan, asks for the contexts of callees it
met, and marks callers of changed exits for the next round. A method's graph is small
and its fixpoint sequential, so a group solves it by a work list with widening at loop
heads. Rounds follow the depth of calls, not the number of methods, and end when nothing is
left to do: exits are widened exactly where methods call themselves or one another.

The domain is a parameter: intervals (here), nullness or octagons (``domains.py``), or list
shapes (``shapes.py``).
Interval states are JSON objects of variable to [lo, hi]; a missing variable is
unconstrained and a null state is unreachable. Contexts are digests of method and entry
state. Location 1 holds the state at the return, 2 that at an exception's way out.

A field or array cell written through one variable may be that of another: every field of
the same name takes the new value in as well. A callee sees the receiver's fields as those
of ``this``, static fields, and one variable ``~.f`` for field f of all other objects.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conefix.functions.interval import FLIPPED, NEGATED, STRICT
from conefix.session import Scratch
from conefix.sources.java import EXC, RET, WHOLE

#: Visits of a loop head, or new exits of a context, that are joined before they are widened.
JOINED = 1
#: Visits after which any location is widened, so that odd graphs settle too.
MANY_VISITS = 200
INF = math.inf
TOP = (-INF, INF)
#: Library methods that change nothing (fixed values).
NO_EFFECT = frozenset("println print printf format equals hashCode toString".split())

State = dict


def context_of(fn: str, entry: str) -> str:
    return hashlib.sha256(f"{fn}|{entry}".encode()).hexdigest()


def dump(state: State | None) -> str | None:
    """The canonical text of a state: open variables do not count."""
    return None if state is None else json.dumps({k: list(v) for k, v in sorted(state.items()) if tuple(v) != TOP})


def load(text: str | None) -> State | None:
    return None if not isinstance(text, str) else {k: tuple(v) for k, v in json.loads(text).items()}


def join(a: State | None, b: State | None) -> State | None:
    if a is None or b is None:
        return b if a is None else a
    return {k: (min(a[k][0], b[k][0]), max(a[k][1], b[k][1])) for k in a.keys() & b.keys()}


def widen(old: State | None, new: State | None) -> State | None:
    if old is None or new is None:
        return new if old is None else old
    out = {k: (old[k][0] if new[k][0] >= old[k][0] else -INF, old[k][1] if new[k][1] <= old[k][1] else INF) for k in old.keys() & new.keys()}
    return {k: v for k, v in out.items() if v != TOP}


def _corners(op, a, b):
    found = [0.0 if math.isnan(x) else x for x in (op(x, y) for x in a for y in b)]
    return min(found), max(found)


def whole(lo: float, hi: float) -> tuple[float, float]:
    """Bounds of what rounding towards zero makes of a range."""
    return (lo if math.isinf(lo) else float(math.trunc(lo))), (hi if math.isinf(hi) else float(math.trunc(hi)))


def cast(kind: str, lo: float, hi: float) -> tuple[float, float]:
    """A cast to a whole type; beyond the range of a small one, any value of it."""
    lo, hi = whole(lo, hi)
    limits = WHOLE.get(kind)
    return (lo, hi) if limits is None or limits[0] <= lo and hi <= limits[1] else limits


def evaluate(e: list, s: State) -> tuple[float, float]:
    tag = e[0]
    if tag == "lit":
        return TOP if e[1] is None else (e[1], e[1])
    if tag == "var":
        return s.get(e[1], TOP)
    if tag == "un":
        lo, hi = evaluate(e[2], s)
        if e[1] == "-":
            return -hi, -lo
        if e[1][0] == "(":
            return cast(e[1][1:-1], lo, hi)
        if e[1] == "!":
            return (0.0, 0.0) if lo > 0 or hi < 0 else (1.0, 1.0) if lo == hi == 0 else (0.0, 1.0)
        return (lo, hi) if e[1] == "+" else (-hi - 1, -lo - 1)
    if tag == "len":
        lo, hi = s.get(f"{e[1]}.#len", s.get(f"{e[1]}.length", TOP))
        return (max(lo, 0.0), hi) if f"{e[1]}.length" not in s else (lo, hi)
    if tag == "cell":
        return cell(s, e[1], evaluate(e[2], s))
    if tag != "bin":
        return TOP
    op, a, b = e[1], evaluate(e[2], s), evaluate(e[3], s)
    if op == "+":
        return a[0] + b[0], a[1] + b[1]
    if op == "-":
        return a[0] - b[1], a[1] - b[0]
    if op == "*":
        return _corners(lambda x, y: x * y, a, b)
    if op in ("/", "//", "/~", "%") and b[0] <= 0 <= b[1]:
        return TOP
    if op in ("/", "//", "/~"):
        real = _corners(lambda x, y: 0.0 if math.isinf(y) and not math.isinf(x) else x / y, a, b)
        rounded = whole(*real)
        return real if op == "/" else rounded if op == "//" else (min(real[0], rounded[0]), max(real[1], rounded[1]))
    if op == "%":
        most = max(abs(b[0]), abs(b[1]))
        return (0.0 if a[0] >= 0 else max(a[0], -most)), (0.0 if a[1] <= 0 else min(a[1], most))
    if op in NEGATED:
        yes, no = refine(e, s, True) is not None, refine(e, s, False) is not None
        return (1.0 if not no else 0.0), (1.0 if yes else 0.0)
    if op in ("<<", ">>", ">>>") and 0 <= b[0] and b[1] < 32 and (op != ">>>" or a[0] >= 0):
        powers = (2.0 ** b[0], 2.0 ** b[1])
        if op == "<<":
            return _corners(lambda x, y: x * y, a, powers)
        lo, hi = _corners(lambda x, y: x / y, a, powers)
        return (lo if math.isinf(lo) else float(math.floor(lo))), (hi if math.isinf(hi) else float(math.floor(hi)))
    return (0.0, 1.0) if op in ("&&", "||", "instanceof") else TOP


def refine(e: list, s: State, truth: bool) -> State | None:
    """The part of a state where an expression is true (or false); None where there is none."""
    if e[0] == "un" and e[1] == "!":
        return refine(e[2], s, not truth)
    if e[0] == "bin" and e[1] in ("&&", "||"):
        if (e[1] == "&&") == truth:
            left = refine(e[2], s, truth)
            return None if left is None else refine(e[3], left, truth)
        return join(refine(e[2], s, truth), refine(e[3], s, truth))
    if e[0] == "bin" and e[1] in NEGATED:
        op = e[1] if truth else NEGATED[e[1]]
        out = dict(s)
        for x, y, o in ((e[2], e[3], op), (e[3], e[2], FLIPPED[op])):
            (lo, hi), (blo, bhi) = evaluate(x, s), evaluate(y, s)
            if o == "==":
                lo, hi = max(lo, blo), min(hi, bhi)
            elif o == "!=":
                if blo == bhi:
                    lo, hi = (lo + STRICT if lo == blo else lo), (hi - STRICT if hi == blo else hi)
            elif o in ("<", "<="):
                hi = min(hi, bhi - (STRICT if o == "<" else 0.0))
            else:
                lo = max(lo, blo + (STRICT if o == ">" else 0.0))
            if lo > hi:
                return None
            if x[0] == "var":
                out[x[1]] = (lo, hi)
        return out
    lo, hi = evaluate(e, s)
    if truth:
        return None if lo == hi == 0 else s
    return None if lo > 0 or hi < 0 else s | ({e[1]: (0.0, 0.0)} if e[0] == "var" else {})


def cell(s: State, arr: str, index: tuple[float, float]) -> tuple[float, float]:
    """All cells that the index may mean, open unless each of them is known."""
    lo, hi = index
    start = f"{arr}.#"
    found = [v for k, v in s.items() if k.startswith(start) and k[len(start) :].isdigit() and lo <= int(k[len(start) :]) <= hi]
    if not found or math.isinf(lo) or math.isinf(hi) or len(found) < math.floor(hi) - math.ceil(lo) + 1:
        return TOP
    return min(v[0] for v in found), max(v[1] for v in found)


def store(stmt: dict, s: State) -> State:
    """Every known cell whose index fits takes the value in; one cell of this array by a known index is replaced."""
    (lo, hi), value, out = evaluate(stmt["index"], s), evaluate(stmt["e"], s), dict(s)
    for name, old in s.items():
        i = name.rpartition(".#")[2] if ".#" in name else ""
        if i.isdigit() and lo <= int(i) <= hi:
            out[name] = (min(old[0], value[0]), max(old[1], value[1]))
    if lo == hi and lo >= 0:
        out[f"{stmt['arr']}.#{int(lo)}"] = value
    return {k: v for k, v in out.items() if v != TOP}


def is_field(name: str) -> bool:
    return "." in name


def is_static(name: str) -> bool:
    """Whether a variable is a static field, by the capital of its class."""
    owner = name.rpartition(".")[0]
    return bool(owner) and owner.split(".")[-1].split("$")[-1][:1].isupper()


def bind_call(stmt: dict, s: State, formals: list[str], varargs: bool) -> State:
    """The callee's entry state: formals, fields of the receiver as ``this``, and static fields."""
    args, n = stmt["args"], len(formals)
    entry = {}
    for i, name in enumerate(formals):
        if i < len(args) and not (varargs and i == n - 1):
            entry[name] = evaluate(args[i], s)
            if args[i][0] == "var" and f"{args[i][1]}.#len" in s:
                entry[f"{name}.#len"] = s[f"{args[i][1]}.#len"]
    for name, value in s.items():
        owner, _, field = name.rpartition(".")
        if owner and owner == stmt["rcvr"]:
            entry[f"this.{field}"] = value
        elif is_static(name):
            entry[name] = value
    entry |= frame(s, stmt["rcvr"], lambda a, b: (min(a[0], b[0]), max(a[1], b[1])))
    return {k: v for k, v in entry.items() if tuple(v) != TOP}


def frame(s: dict, rcvr: str | None, merge: Callable) -> dict:
    """Each field of objects other than the receiver, as one variable for all of them."""
    out: dict = {}
    for name, value in s.items():
        owner, _, field = name.rpartition(".")
        if owner and owner != rcvr and not is_static(name) and field != "#len":
            out[f"~.{field}"] = merge(out[f"~.{field}"], value) if f"~.{field}" in out else value
    return out


def unframed(s: dict, rcvr: str | None, exit_state: dict) -> dict:
    """The caller's variables after a call, without the receiver's and static fields: other fields are what the frame says."""
    out = {}
    for name, value in s.items():
        owner, _, field = name.rpartition(".")
        if not owner or field == "#len":
            out[name] = value
        elif owner != rcvr and not is_static(name) and f"~.{field}" in exit_state:
            out[name] = exit_state[f"~.{field}"]
    return out


def bind_return(stmt: dict, s: State, exit_state: State, lhs: str | None, result: str) -> State:
    """The caller's state after the call: result, the receiver's fields and static fields from the callee."""
    rcvr = stmt["rcvr"]
    out = unframed(s, rcvr, exit_state)
    for name, value in exit_state.items():
        owner, _, field = name.rpartition(".")
        if owner == "this" and rcvr:
            out[f"{rcvr}.{field}"] = value
        elif is_static(name):
            out[name] = value
    out = assigned(out, lhs, exit_state.get(result, TOP))
    if lhs is not None and f"{result}.#len" in exit_state:
        out[f"{lhs}.#len"] = exit_state[f"{result}.#len"]
    return out


def assigned(s: State, name: str | None, value: tuple[float, float]) -> State:
    if name is None:
        return s
    out = {k: v for k, v in s.items() if k != name and not k.startswith(f"{name}.")}
    if value != TOP:
        out[name] = value
    return out


def aliased(s: State, name: str, value: tuple[float, float]) -> State:
    """A field was written: fields of that name of other variables may be the same one."""
    if not is_field(name) or is_static(name) or name.endswith(".#len"):
        return s
    end = f".{name.rpartition('.')[2]}"
    out = {k: (min(v[0], value[0]), max(v[1], value[1])) if k.endswith(end) and k != name and not is_static(k) else v for k, v in s.items()}
    return {k: v for k, v in out.items() if v != TOP}


def copied(s: State, name: str, e: list) -> State:
    """Assignment; fields known of the copied variable are known of the new one."""
    value = evaluate(e, s)
    out = aliased(assigned(s, name, value), name, value)
    if e[0] == "var":
        out |= {f"{name}.{k[len(e[1]) + 1 :]}": v for k, v in s.items() if k.startswith(f"{e[1]}.") and not k.startswith(f"{name}.")}
    return out


def unknown_call(stmt: dict, s: State, lhs: str | None) -> State | None:
    """No source: result, fields and static fields are open unless the method is known to change and throw nothing."""
    quiet = stmt["name"] in NO_EFFECT
    if quiet and stmt["k"] == "xcall":
        return None
    return assigned(s if quiet else {k: v for k, v in s.items() if not is_field(k) or k.endswith(".#len")}, lhs, TOP)


def step(stmt: dict, s: State) -> State | None:
    """The state behind a statement that is no call; None where control does not come."""
    if stmt["k"] == "assign":
        return copied(s, stmt["lhs"], stmt["e"])
    if stmt["k"] == "assume":
        return refine(stmt["e"], s, True)
    return store(stmt, s) if stmt["k"] == "store" else s


@dataclass(frozen=True)
class Domain:
    """What the engine asks of abstract states; None is bottom for all of them, ``{}`` the open entry state's text."""

    dump: Callable
    load: Callable
    join: Callable
    widen: Callable
    step: Callable
    bind_call: Callable
    bind_return: Callable
    unknown_call: Callable


INTERVALS = Domain(dump, load, join, widen, step, bind_call, bind_return, unknown_call)


def domain_named(name: str) -> Domain:
    from conefix.plans import domains, shapes

    return {"interval": INTERVALS, "nullness": domains.NULLNESS, "octagon": domains.OCTAGONS, "shape": shapes.SHAPES}[name]


def loop_heads(follow: dict[int, list]) -> set[int]:
    """Targets of back edges of a depth-first search from the entry."""
    state, heads, stack = {0: 1}, set(), [(0, iter(follow.get(0, ())))]
    while stack:
        node, rest = stack[-1]
        for child, _ in rest:
            if state.get(child) == 1:
                heads.add(child)
            elif child not in state:
                state[child] = 1
                stack.append((child, iter(follow.get(child, ()))))
                break
        else:
            state[node] = 2
            stack.pop()
    return heads


def solve(
    fn: str, edges: list[tuple[int, int, dict]], entry: State, callees: dict[int, list[dict]], exits: dict[str, tuple[State | None, State | None]], d: Domain = INTERVALS
) -> tuple[dict[int, State], list[tuple[str, str, str]]]:
    """All cells of a method under an entry state, and the callee contexts it met.

    ``callees``: by the position of a call among the edges. ``exits``: known states at return
    and exception by context; a context that is not there is asked for and unreachable for now.
    """
    follow: dict[int, list] = defaultdict(list)
    for i, (src, dst, stmt) in enumerate(edges):
        follow[src].append((dst, i))
    heads = loop_heads(follow)
    cells: dict[int, State] = {0: entry}
    incoming: dict[int, dict[int, State]] = defaultdict(dict)
    asked: dict[str, tuple[str, str, str]] = {}
    visits: dict[int, int] = defaultdict(int)
    work = [0]
    while work:
        src = work.pop(0)
        for dst, i in follow.get(src, ()):
            stmt, s = edges[i][2], cells[src]
            if stmt["k"] in ("call", "xcall"):
                thrown = stmt["k"] == "xcall"
                lhs, result = (EXC, EXC) if thrown else (stmt["lhs"], RET)
                out = None if callees.get(i) else d.unknown_call(stmt, s, lhs)
                for c in callees.get(i, ()):
                    inner = d.bind_call(stmt, s, c["formals"], c["varargs"])
                    if inner is None:
                        continue
                    if c["fn"] == fn:
                        inner = d.widen(entry, d.join(entry, inner))
                    elif c["mutual"]:
                        inner = d.load("{}")
                    text = d.dump(inner)
                    ctx = context_of(c["fn"], text)
                    asked[ctx] = (ctx, c["fn"], text)
                    left = exits.get(ctx, (None, None))[thrown]
                    if left is not None:
                        out = d.join(out, d.bind_return(stmt, s, left, lhs, result))
            else:
                out = d.step(stmt, s)
            if out is None:
                continue
            incoming[dst][i] = out
            merged = None
            for one in incoming[dst].values():
                merged = d.join(merged, one)
            if dst == 0:
                merged = d.join(entry, merged)
            old = cells.get(dst)
            if old is not None:
                merged = d.join(old, merged)
                visits[dst] += 1
                if visits[dst] > (JOINED if dst in heads else MANY_VISITS):
                    merged = d.widen(old, merged)
            if old is None or d.dump(old) != d.dump(merged):
                cells[dst] = merged
                if dst not in work:
                    work.append(dst)
    return cells, list(asked.values())


def _last(name: str) -> F.Column:
    return F.element_at(F.split(F.col(name), r"[.$]"), -1)


def ancestors(hierarchy: DataFrame, scratch: Scratch) -> DataFrame:
    """``(program, cls, up, depth)`` by simple names: each class with its super classes and interfaces, itself at depth 0. A cycle ends it, as pairs count once."""
    pairs = hierarchy.select("program", _last("child").alias("cls"), _last("parent").alias("up")).where("cls != up").distinct()
    classes = pairs.select("program", "cls").union(pairs.select("program", "up")).distinct()
    known = newest = scratch.save(classes.select("program", "cls", F.col("cls").alias("up"), F.lit(0).alias("depth")), "up-0")
    depth = 0
    while not newest.isEmpty():
        depth += 1
        step = newest.select("program", "cls", F.col("up").alias("mid")).join(pairs.withColumnRenamed("cls", "mid"), ["program", "mid"]).select("program", "cls", "up").distinct()
        newest = scratch.save(step.join(known, ["program", "cls", "up"], "left_anti").withColumn("depth", F.lit(depth)), f"up-{depth}")
        known = known.unionByName(newest)
    return known


def call_targets(edges: DataFrame, methods: DataFrame, calls: DataFrame | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """``(program, fn, pos, callee, formals, varargs)``: methods that a call may reach, by name, arity and, where known, class.

    Of the class and its ancestors the nearest that has the method counts, and unless the
    call is exact all subclasses that have it (``hierarchy(program, child, parent)``).
    ``calls(program, caller, callee)`` of a call graph keeps only its pairs.
    """
    site = F.from_json("stmt", "k string, rcvr string, cls string, name string, args array<string>, exact boolean").alias("c")
    sites = edges.select("program", "fn", "pos", site).where("c.k IN ('call', 'xcall')").select("program", "fn", "pos", "c.cls", "c.name", F.coalesce("c.exact", F.lit(False)).alias("exact"), F.size("c.args").alias("n"))
    sites = sites.withColumn("cls", _last("cls"))
    m = methods.select("program", F.col("fn").alias("callee"), F.col("method_name").alias("name"), _last("class_name").alias("own"), "formals", "varargs")
    fits = (F.size("formals") == F.col("n")) | F.col("varargs") & (F.col("n") >= F.size("formals") - 1)
    named = sites.join(m, ["program", "name"]).where(fits)
    if hierarchy is None:
        found = named.where("cls IS NULL OR cls = own")
    else:
        up = ancestors(hierarchy, Scratch(edges.sparkSession, "classes"))
        above = up.select("program", "cls", F.col("up").alias("own"), "depth")
        below = up.where("depth > 0").select("program", F.col("up").alias("cls"), F.col("cls").alias("own"), F.lit(True).alias("sub"))
        placed = named.join(above, ["program", "cls", "own"], "left").join(below, ["program", "cls", "own"], "left")
        depth = F.when(F.col("cls") == F.col("own"), 0).otherwise(F.col("depth"))
        nearest = F.min("up").over(Window.partitionBy("program", "fn", "pos"))
        placed = placed.withColumn("up", depth).withColumn("nearest", nearest)
        found = placed.where("cls IS NULL OR up = nearest OR sub AND NOT exact")
    found = found.select("program", "fn", "pos", "callee", "formals", "varargs").distinct()
    if calls is not None:
        found = found.join(calls.select("program", F.col("caller").alias("fn"), "callee").distinct(), ["program", "fn", "callee"], "left_semi")
    return found


def call_cycles(targets: DataFrame) -> DataFrame:
    """``(program, fn, cycle)`` of the methods that call one another in a circle, several of them. A program's call graph is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        follow: dict[str, list[str]] = defaultdict(list)
        for a, b in zip(group["fn"], group["callee"], strict=True):
            follow[a].append(b)
        rows, index, low, stack, on = [], {}, {}, [], set()
        for start in list(follow):
            work = [(start, iter(follow[start]))] if start not in index else []
            for node, _ in work:
                index[node] = low[node] = len(index)
                stack.append(node)
                on.add(node)
            while work:
                node, rest = work[-1]
                for child in rest:
                    if child not in index:
                        index[child] = low[child] = len(index)
                        stack.append(child)
                        on.add(child)
                        work.append((child, iter(follow.get(child, ()))))
                        break
                    if child in on:
                        low[node] = min(low[node], index[child])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == index[node]:
                        part = []
                        while not part or part[-1] != node:
                            part.append(stack.pop())
                            on.discard(part[-1])
                        if len(part) > 1:
                            rows += [(group["program"].iloc[0], fn, min(part)) for fn in part]
        return pd.DataFrame(rows, columns=["program", "fn", "cycle"])

    return targets.select("program", "fn", "callee").distinct().groupBy("program").applyInPandas(run, "program string, fn string, cycle string")


def bodies_of(edges: DataFrame, methods: DataFrame, mutual: DataFrame | None = None, calls: DataFrame | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """``(program, fn, edges, digest)``: each method's edges with the callees of its calls; equal digests, equal behaviour of the method itself.

    Callees in a call cycle with their caller are ``mutual``; ``mutual(program, fn)`` names more of them.
    """
    keyed = edges.select("program", "fn", "src", "dst", "stmt", F.xxhash64("src", "dst", "stmt").alias("pos"))
    targets = Scratch(edges.sparkSession, "targets").save(call_targets(keyed, methods, calls, hierarchy), "targets")
    cycles = call_cycles(targets)
    own, other = cycles.withColumnRenamed("cycle", "a"), cycles.select("program", F.col("fn").alias("callee"), F.col("cycle").alias("b"))
    targets = targets.join(own, ["program", "fn"], "left").join(other, ["program", "callee"], "left").withColumn("mutual", F.coalesce(F.col("a") == F.col("b"), F.lit(False)) & (F.col("fn") != F.col("callee")))
    if mutual is not None:
        targets = targets.join(mutual.select("program", F.col("fn").alias("callee"), F.lit(True).alias("given")).distinct(), ["program", "callee"], "left").withColumn("mutual", F.col("mutual") | F.coalesce("given", F.lit(False)))
    called = targets.groupBy("program", "fn", "pos").agg(F.sort_array(F.collect_list(F.struct(F.col("callee").alias("fn"), "formals", "varargs", "mutual"))).alias("callees"))
    body = keyed.join(called, ["program", "fn", "pos"], "left").withColumn("edge", F.to_json(F.struct("src", "dst", "stmt", "callees")))
    listed = body.groupBy("program", "fn").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return listed.withColumn("digest", F.sha2(F.to_json("edges"), 256))


def analyse(edges: DataFrame, methods: DataFrame, demand: DataFrame, mutual: DataFrame | None = None, calls: DataFrame | None = None, domain: str = "interval", hierarchy: DataFrame | None = None) -> DataFrame:
    """Cells ``(program, fn, ctx, entry, loc, state)`` of everything the demand needs, and no more.

    ``edges(program, fn, src, dst, stmt)``, ``methods(program, fn, ...)``, ``demand(program, fn, entry)``
    with entry states as JSON. Methods of call cycles of several methods are called under the
    unconstrained entry, as are those of ``mutual(program, fn)``.
    """
    scratch = Scratch(edges.sparkSession, "analysis")
    bodies = scratch.save(bodies_of(edges, methods, mutual, calls, hierarchy), "bodies")
    return cells_of(demanded(bodies, demand, scratch, domain=domain))


def located(bodies: DataFrame, places: DataFrame, scratch: Scratch, domain: str = "interval") -> DataFrame:
    """Cells of ``places(program, fn, loc)`` without an entry state: those under every entry that callers give.

    What may come before a place are the methods that reach it by calls. Those of them that
    nobody calls start unconstrained; where there are none, as in a closed circle of calls,
    the place's own method does.
    """
    from conefix.operators import graph

    calls = bodies.select("program", "fn", F.explode("edges").alias("e")).select("program", "fn", F.explode(F.from_json("e", "callees array<struct<fn:string>>")["callees"]["fn"]).alias("callee")).distinct()
    name = lambda c: F.concat_ws("|", "program", c)
    seeds = places.select("program", "fn").distinct()
    above = graph.reach(calls.select(name("callee").alias("src"), name("fn").alias("dst")), seeds.select(name("fn").alias("origin"), name("fn").alias("node")))
    roots = above.join(calls.select(name("callee").alias("node")).distinct(), "node", "left_anti")
    alone = seeds.withColumn("node", name("fn")).join(roots.select(F.col("origin").alias("node")), "node", "left_anti").select("program", "fn")
    entries = roots.select(F.substring_index("node", "|", 1).alias("program"), F.expr("substring(node, length(substring_index(node, '|', 1)) + 2)").alias("fn")).union(alone).distinct()
    solved = demanded(bodies, entries.withColumn("entry", F.lit("{}")), scratch, name="located", domain=domain)
    return cells_of(solved).join(places.select("program", "fn", "loc").distinct(), ["program", "fn", "loc"])


def cells_of(solved: DataFrame) -> DataFrame:
    return solved.where("kind = 'cell'").select("program", "fn", "ctx", "entry", "loc", "state")


def demanded(bodies: DataFrame, demand: DataFrame, scratch: Scratch, reuse: DataFrame | None = None, name: str = "solved", domain: str = "interval") -> DataFrame:
    """The solved table ``(program, fn, ctx, entry, kind, loc, state, asked, used)``: cells, the states at return and exception as a pair, and the contexts that each context asked for.

    ``reuse``: an earlier solved table of which every row still holds; what the demand finds there is not computed again.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        d, rows = domain_named(domain), []

        def pair(text: str) -> tuple:
            return tuple(None if x is None else d.load(json.dumps(x)) for x in json.loads(text))

        for r in group.to_dict("records"):
            raw = [json.loads(x) for x in r["edges"]]
            raw.sort(key=lambda x: (x["src"], x["dst"], x["stmt"]))
            used = dict(zip(r["known"], r["states"], strict=True))
            exits = {k: pair(v) for k, v in used.items()}
            cells, asked = solve(r["fn"], [(x["src"], x["dst"], json.loads(x["stmt"])) for x in raw], d.load(r["entry"]), {i: x["callees"] for i, x in enumerate(raw) if x.get("callees")}, exits, d)
            key, old = (r["program"], r["fn"], r["ctx"], r["entry"]), r["old"]
            callees = [c for x in raw for c in x.get("callees") or ()]
            if isinstance(old, str) and (any(c["mutual"] for c in callees) or any(a[0] == r["ctx"] for a in asked)):
                for loc, state in zip((1, 2), pair(old), strict=True):
                    if state is not None:
                        cells[loc] = d.widen(state, d.join(state, cells.get(loc)))
            left = [d.dump(cells.get(1)), d.dump(cells.get(2))]
            rows += [(*key, "cell", loc, d.dump(s), None, None) for loc, s in cells.items()]
            if left != [None, None]:
                rows.append((*key, "exit", None, f"[{', '.join(x or 'null' for x in left)}]", None, None))
            rows += [(*key, "ask", None, state, f"{ctx}|{callee}", used.get(ctx)) for ctx, callee, state in asked]
        return pd.DataFrame(rows, columns=["program", "fn", "ctx", "entry", "kind", "loc", "state", "asked", "used"]).astype({"loc": "Int64"})

    schema = "program string, fn string, ctx string, entry string, kind string, loc long, state string, asked string, used string"
    ctx = F.sha2(F.concat_ws("|", "fn", "entry"), 256)
    todo = demand.select("program", "fn", "entry").distinct().withColumn("ctx", ctx)
    solved = reuse
    if reuse is not None:
        wanted = reuse.where("kind = 'ask'").select("program", F.substring_index("asked", "|", -1).alias("fn"), F.col("state").alias("entry"), F.substring_index("asked", "|", 1).alias("ctx"))
        todo = todo.unionByName(wanted).distinct().join(reuse.select("program", "ctx").distinct(), ["program", "ctx"], "left_anti")
    for turn in itertools.count():
        if solved is None:
            inputs = todo.withColumns({"known": F.array().cast("array<string>"), "states": F.array().cast("array<string>"), "old": F.lit(None).cast("string")})
        else:
            exits = solved.where("kind = 'exit'").select("program", F.col("ctx").alias("c"), "state")
            asks = solved.where("kind = 'ask'").select("program", "ctx", F.substring_index("asked", "|", 1).alias("c")).distinct()
            have = asks.join(exits, ["program", "c"]).groupBy("program", "ctx").agg(F.sort_array(F.collect_list(F.struct("c", "state"))).alias("h"))
            old = exits.withColumnsRenamed({"c": "ctx", "state": "old"})
            inputs = todo.join(have, ["program", "ctx"], "left").join(old, ["program", "ctx"], "left")
            inputs = inputs.withColumns({"known": F.coalesce(F.transform("h", lambda x: x["c"]), F.array().cast("array<string>")), "states": F.coalesce(F.transform("h", lambda x: x["state"]), F.array().cast("array<string>"))}).drop("h")
        ready = inputs.join(bodies, ["program", "fn"]).select("program", "fn", "ctx", "entry", "edges", "known", "states", "old")
        fresh = scratch.save(ready.groupBy("program", "fn", "ctx").applyInPandas(run, schema), f"{name}-{turn}")
        if solved is None:
            solved = fresh
        else:
            done = fresh.select("program", "ctx").distinct()
            solved = scratch.save(solved.join(done, ["program", "ctx"], "left_anti").unionByName(fresh), f"{name}-all-{turn}")
        asks = solved.where("kind = 'ask'").select("program", "ctx", "fn", "entry", F.substring_index("asked", "|", 1).alias("c"), F.substring_index("asked", "|", -1).alias("callee"), "state", "used")
        new = asks.select("program", F.col("callee").alias("fn"), F.col("state").alias("entry"), F.col("c").alias("ctx")).distinct().join(solved.select("program", "ctx").distinct(), ["program", "ctx"], "left_anti")
        # A context is stale if an exit that it asked for is not the one it was solved with.
        exits = solved.where("kind = 'exit'").select("program", F.col("ctx").alias("c"), F.col("state").alias("now"))
        stale = asks.join(exits, ["program", "c"]).where(~F.col("now").eqNullSafe(F.col("used"))).select("program", "fn", "entry", "ctx").distinct()
        todo = scratch.save(new.select("program", "fn", "entry", "ctx").unionByName(stale).distinct(), f"{name}-todo-{turn}")
        if todo.isEmpty():
            return solved
