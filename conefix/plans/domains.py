"""More abstract domains for the analysis: nullness, and intervals together with octagons.

Nullness states are objects of variable to a mask, 1 null, 2 an object, 3 either; a missing
variable is 3. Using null as an object ends the path, and what was used is an object after.

Octagon states are pairs: the interval state, and an octagon over at most five locals and
array lengths, which keeps sums and differences of two of them. Each part sharpens the
other where a statement is evaluated, never at a loop head, so that widening ends.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from conefix.functions.interval import FLIPPED, NEGATED, STRICT
from conefix.functions.octagon import INF, MAX_VARIABLES, Octagon
from conefix.plans import analysis as itv
from conefix.plans.analysis import Domain, is_field, is_static
from conefix.sources.java import EXC

NULL, OBJECT, EITHER = 1, 2, 3
Masks = dict


def _used(e: list) -> list[str]:
    """Variables that an expression uses as objects, the owners first."""
    if e[0] == "var":
        owner = e[1].rpartition(".")[0]
        return [] if not owner or is_static(e[1]) else [*_used(["var", owner]), owner]
    if e[0] == "len":
        return [*_used(["var", e[1]]), e[1]]
    if e[0] == "cell":
        return [*_used(["var", e[1]]), e[1], *_used(e[2])]
    return [v for part in e[2:] if isinstance(part, list) for v in _used(part)] if e[0] in ("bin", "un") else []


def used_by(stmt: dict) -> list[str]:
    """Variables that a statement uses as objects, in order."""
    if stmt["k"] in ("call", "xcall"):
        used = [v for e in stmt["args"] for v in _used(e)]
        return used + [*_used(["var", stmt["rcvr"]]), stmt["rcvr"]] if stmt["rcvr"] else used
    if stmt["k"] == "store":
        return [*_used(["cell", stmt["arr"], stmt["index"]]), *_used(stmt["e"])]
    own = _used(["var", stmt["lhs"]]) if stmt["k"] == "assign" else []
    return [*_used(stmt["e"]), *own] if "e" in stmt else own


def null_of(e: list, s: Masks) -> int:
    if e[0] == "lit":
        return NULL if e[1] is None else OBJECT
    if e[0] == "var":
        return OBJECT if e[1] == "this" else s.get(e[1], EITHER)
    return EITHER if e[0] in ("any", "cell") else OBJECT


def _use(names: list[str], s: Masks | None) -> Masks | None:
    for name in names:
        if s is None or null_of(["var", name], s) == NULL:
            return None
        s = s if name == "this" else s | {name: OBJECT}
    return s


def null_join(a: Masks | None, b: Masks | None) -> Masks | None:
    if a is None or b is None:
        return b if a is None else a
    return {k: a[k] | b[k] for k in a.keys() & b.keys() if a[k] | b[k] != EITHER}


def null_dump(s: Masks | None) -> str | None:
    return None if s is None else json.dumps({k: v for k, v in sorted(s.items()) if v != EITHER})


def null_load(text: str | None) -> Masks | None:
    return json.loads(text) if isinstance(text, str) else None


def null_refine(e: list, s: Masks | None, truth: bool) -> Masks | None:
    if s is None:
        return None
    if e[0] == "un" and e[1] == "!":
        return null_refine(e[2], s, not truth)
    if e[0] == "bin" and e[1] in ("&&", "||"):
        if (e[1] == "&&") == truth:
            return null_refine(e[3], null_refine(e[2], s, truth), truth)
        return null_join(null_refine(e[2], s, truth), null_refine(e[3], null_refine(e[2], s, not truth), truth))
    s = _use(_used(e), s)
    if s is not None and truth and e[0] == "bin" and e[1] == "instanceof":
        return _use([e[2][1]], s) if e[2][0] == "var" else s
    if s is None or e[0] != "bin" or e[1] not in ("==", "!="):
        return s
    same, found = (e[1] == "==") == truth, [null_of(x, s) for x in e[2:4]]
    if same and not found[0] & found[1] or not same and found == [NULL, NULL]:
        return None
    for x, own, other in ((e[2], *found), (e[3], *found[::-1])):
        if x[0] == "var" and x[1] != "this":
            left = own & other if same else own & ~NULL if other == NULL else own
            if not left:
                return None
            s = s | {x[1]: left}
    return s


def _put(s: Masks, name: str | None, value: int) -> Masks:
    """Assignment; a field may be that of another variable as well."""
    if name is None:
        return s
    out = {k: v for k, v in s.items() if k != name and not k.startswith(f"{name}.")}
    if is_field(name) and not is_static(name):
        end = f".{name.rpartition('.')[2]}"
        out = {k: v | value if k.endswith(end) and not is_static(k) else v for k, v in out.items()}
    return {k: v for k, v in (out | {name: value}).items() if v != EITHER}


def null_step(stmt: dict, s: Masks) -> Masks | None:
    if stmt["k"] == "assume":
        return null_refine(stmt["e"], s, True)
    if stmt["k"] == "store":
        return _use(used_by(stmt), s)
    if stmt["k"] != "assign":
        return s
    e, name = stmt["e"], stmt["lhs"]
    s = _use(used_by(stmt), s)
    if s is None:
        return None
    out = _put(s, name, null_of(e, s) if name != EXC else OBJECT)
    if e[0] == "var":
        out |= {f"{name}.{k[len(e[1]) + 1 :]}": v for k, v in s.items() if k.startswith(f"{e[1]}.") and not k.startswith(f"{name}.")}
    return out


def _called(stmt: dict, s: Masks) -> Masks | None:
    """The caller's state when the call begins: receiver and arguments have been used."""
    return _use(used_by(stmt), s)


def null_call(stmt: dict, s: Masks, formals: list[str], varargs: bool) -> Masks | None:
    s = _called(stmt, s)
    if s is None:
        return None
    entry, n = {}, len(formals)
    for i, name in enumerate(formals):
        if varargs and i == n - 1:
            entry[name] = OBJECT if len(stmt["args"]) != n else EITHER
        elif i < len(stmt["args"]):
            entry[name] = null_of(stmt["args"][i], s)
    for name, value in s.items():
        owner, _, field = name.rpartition(".")
        if owner and owner == stmt["rcvr"]:
            entry[f"this.{field}"] = value
        elif is_static(name):
            entry[name] = value
    entry |= itv.frame(s, stmt["rcvr"], lambda a, b: a | b)
    return {k: v for k, v in entry.items() if v != EITHER}


def null_return(stmt: dict, s: Masks, exit_state: Masks, lhs: str | None, result: str) -> Masks:
    out = itv.unframed(_called(stmt, s) or {}, stmt["rcvr"], exit_state)
    for name, value in exit_state.items():
        owner, _, field = name.rpartition(".")
        if owner == "this" and stmt["rcvr"]:
            out[f"{stmt['rcvr']}.{field}"] = value
        elif is_static(name):
            out[name] = value
    return _put(out, lhs, OBJECT if lhs == EXC else exit_state.get(result, EITHER))


def null_unknown(stmt: dict, s: Masks, lhs: str | None) -> Masks | None:
    out, quiet = _called(stmt, s), stmt["name"] in itv.NO_EFFECT
    if out is None or quiet and stmt["k"] == "xcall":
        return None
    return _put(out if quiet else {k: v for k, v in out.items() if not is_field(k)}, lhs, OBJECT if lhs == EXC else EITHER)


NULLNESS = Domain(null_dump, null_load, null_join, null_join, null_step, null_call, null_return, null_unknown)


# --- intervals and octagons --------------------------------------------------


@dataclass(frozen=True)
class Both:
    box: dict
    oct: Octagon

    def sharp(self) -> dict | None:
        """The intervals with what the octagon adds; None if the two exclude each other."""
        out = dict(self.box)
        for name in self.oct.names:
            (a, b), (c, d) = out.get(name, itv.TOP), self.oct.bounds(name)
            out[name] = (max(a, c), min(b, d))
            if out[name][0] > out[name][1]:
                return None
        return {k: v for k, v in out.items() if v != itv.TOP}


def _tracked(name: str) -> bool:
    return not is_field(name) or name.endswith(".#len")


def _linear(e: list) -> tuple[int, str | None, float] | None:
    """``sign * variable + constant``; no variable for a constant."""
    if e[0] == "lit" and e[1] is not None:
        return 0, None, e[1]
    if e[0] == "var" and _tracked(e[1]):
        return 1, e[1], 0.0
    if e[0] == "len":
        return 1, f"{e[1]}.#len", 0.0
    if e[0] == "un" and e[1] in "+-":
        one = _linear(e[2])
        return one if one is None or e[1] == "+" else (-one[0], one[1], -one[2])
    if e[0] == "bin" and e[1] in "+-":
        a, b = _linear(e[2]), _linear(e[3])
        if a and b and (a[1] is None or b[1] is None):
            sign = 1 if e[1] == "+" else -1
            return (*(a[:2] if b[1] is None else (sign * b[0], b[1])), a[2] + sign * b[2])
    return None


def at_most(o: Octagon, a: list, b: list) -> float:
    """An upper bound of the difference of two expressions from the octagon, infinite if it knows none."""
    x, y = _linear(a), _linear(b)
    if not x or not y or x[1] not in o.names or y[1] not in o.names or x[0] != 1 or y[0] != 1:
        return INF
    return float(o.close().m[o.row(y[1], 1), o.row(x[1], 1)]) + x[2] - y[2]


def both_dump(s: Both | None) -> str | None:
    if s is None:
        return None
    out = {"box": json.loads(itv.dump(s.box)), "oct": sorted(map(list, s.oct.rows()))}
    return json.dumps({k: v for k, v in out.items() if v})


def both_load(text: str | None) -> Both | None:
    if not isinstance(text, str):
        return None
    data = json.loads(text)
    rows = data.get("oct", [])
    out = Octagon.top({r[i] for r in rows for i in (0, 2)})
    for v1, s1, v2, s2, c in rows:
        i, j = out.row(v1, -s1), out.row(v2, s2)
        out.m[i, j] = min(out.m[i, j], c)
    return Both({k: tuple(v) for k, v in data.get("box", {}).items()}, out)


def both_join(a: Both | None, b: Both | None) -> Both | None:
    return (b if a is None else a) if a is None or b is None else Both(itv.join(a.box, b.box), a.oct.join(b.oct))


def both_widen(a: Both | None, b: Both | None) -> Both | None:
    return (b if a is None else a) if a is None or b is None else Both(itv.widen(a.box, b.box), a.oct.widen(b.oct))


def _checked(box: dict | None, octagon: Octagon) -> Both | None:
    return None if box is None or octagon.is_bottom() else Both(box, octagon)


def _assume(e: list, o: Octagon, truth: bool) -> Octagon:
    """Constraints of comparisons between two linear sides; a disjunction joins."""
    if e[0] == "un" and e[1] == "!":
        return _assume(e[2], o, not truth)
    if e[0] == "bin" and e[1] in ("&&", "||"):
        if (e[1] == "&&") == truth:
            return _assume(e[3], _assume(e[2], o, truth), truth)
        return _assume(e[2], o, truth).join(_assume(e[3], o, truth))
    if e[0] != "bin" or e[1] not in NEGATED:
        return o
    op, sides = e[1] if truth else NEGATED[e[1]], (_linear(e[2]), _linear(e[3]))
    if None in sides or op == "!=":
        return o
    names = [n for _, n, _ in sides if n and n not in o.names]
    o = o.over((*o.names, *names)) if len(o.names) + len(set(names)) <= MAX_VARIABLES else o
    for (s, x, c), (t, y, k), way in ((*sides, op), (*sides[::-1], FLIPPED[op])):
        if way in ("<", "<=", "=="):  # s x + c <= t y + k
            terms = [(a, n) for a, n in ((s, x), (-t, y)) if n]
            if terms:
                o = o.constrain(terms, k - c - (STRICT if way == "<" else 0.0))
    return o


def both_step(stmt: dict, s: Both) -> Both | None:
    box = s.sharp()
    if box is None:
        return None
    after = itv.step(stmt, box)
    if stmt["k"] == "assume":
        return _checked(after, _assume(stmt["e"], s.oct, True))
    if stmt["k"] != "assign" or not _tracked(stmt["lhs"]):
        return _checked(after, s.oct)
    name, e, o, line = stmt["lhs"], stmt["e"], s.oct, _linear(stmt["e"])
    if e[0] == "var" and f"{e[1]}.#len" in o.names and e[1] != name:
        o = o.assign(f"{name}.#len", source=(1, f"{e[1]}.#len", 0.0))
    elif f"{name}.#len" in o.names:
        o = o.forget(f"{name}.#len")
    source = line if line and line[1] in o.names and line[0] else None
    o = o.assign(name, itv.evaluate(e, box), source)
    if e[0] == "var" and e[1].startswith("$"):  # a temporary has one use
        for gone in (e[1], f"{e[1]}.#len"):
            o = o.forget(gone) if gone in o.names else o
    return _checked(after, o)


def both_call(stmt: dict, s: Both, formals: list[str], varargs: bool) -> Both | None:
    """Relations between linear arguments become relations between formals."""
    box = s.sharp()
    if box is None:
        return None
    lines = {f: _linear(e) for f, e in zip(formals[: len(formals) - varargs], stmt["args"], strict=False)}
    wanted = {f: x for f, x in lines.items() if x and x[1] in s.oct.names}
    sources = sorted({x[1] for x in wanted.values()})
    o, made = s.oct.over(tuple(sources)), []
    for f, x in wanted.items():
        before = o.names
        o = o.assign(f"\0{f}", source=x)
        made += [f"\0{f}"] if o.names != before else []
    o = o.over(tuple(made))
    return Both(itv.bind_call(stmt, box, formals, varargs), Octagon(tuple(n[1:] for n in o.names), np.array(o.m)))


def both_return(stmt: dict, s: Both, exit_state: Both, lhs: str | None, result: str) -> Both | None:
    box, left = s.sharp(), exit_state.sharp()
    if box is None or left is None:
        return None
    return _checked(itv.bind_return(stmt, box, left, lhs, result), _result(s.oct, lhs, left.get(result, itv.TOP)))


def _result(o: Octagon, lhs: str | None, value: tuple[float, float]) -> Octagon:
    if lhs is None or is_field(lhs):
        return o
    if f"{lhs}.#len" in o.names:
        o = o.forget(f"{lhs}.#len")
    return o.assign(lhs, value) if value != (-INF, INF) else o.forget(lhs) if lhs in o.names else o


def both_unknown(stmt: dict, s: Both, lhs: str | None) -> Both | None:
    box = itv.unknown_call(stmt, s.box, lhs)
    return None if box is None else _checked(box, _result(s.oct, lhs, itv.TOP))


OCTAGONS = Domain(both_dump, both_load, both_join, both_widen, both_step, both_call, both_return, both_unknown)
