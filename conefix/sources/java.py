"""A front end for a subset of Java: source text to methods and control-flow edges.

A recursive-descent parser lowers each method straight to edges ``(src, dst, stmt)``.
Side effects leave expressions: calls become statements that assign fresh temporaries,
in evaluation order. Statements and expressions are JSON:

    {"k": "assign", "lhs": name, "e": expr}   {"k": "assume", "e": expr}   {"k": "skip"}
    {"k": "call", "lhs": name, "rcvr": name or null, "cls": class or null, "name": method, "args": [expr], "exact": bool}
    {"k": "store", "arr": name, "index": expr, "e": expr}
    ["lit", number or null]   ["var", name]   ["bin", op, l, r]   ["un", op, e]   ["any"]
    ["obj"], some object   ["obj", "new"], one that no one else holds   ["len", array]   ["cell", array, index]   ["type", name], right of instanceof

A floating literal has a third part, "f". Division is "//" between whole numbers, "/" where
a side is floating and "/~" where types are not known; a cast to a whole type is the unary
operator "(int)" and so on. An exact call (super, constructors, static) has the methods of
its class alone, others those of its subclasses as well. An operand is held in a temporary
where what is evaluated after it has effects, so that the order of evaluation is Java's.

A method enters at 0, returns at 1 and throws at 2. Each call has a twin, ``xcall``, to
the handler around it, for what it throws. A finally block and the closing of resources
are lowered once for each way out. Only calls and throw statements throw.

Fields are variables named ``this.f``, ``r.f`` or ``Class.f``; an array's length is ``a.#len``
and a cell ``a.#3``. Nested classes are named ``Outer$Inner``. What the subset leaves out
(lambdas, anonymous classes, switch expressions) makes the method a row of ``unsupported``
with the form, not an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.session import ship

_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/|(?P<num>0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|0[oO][0-7_]+[lL]?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_$][\w$]*)"
    r"|(?P<op>>>>=|<<=|>>=|>>>|>>|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|->|::|\.\.\.|<<|[-+*/%=<>!~?:;,.(){}\[\]&|^@])",
    re.S,
)
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
WHOLE = {"byte": (-128.0, 127.0), "short": (-32768.0, 32767.0), "char": (0.0, 65535.0), "int": None, "long": None, "Byte": None, "Short": None, "Character": None, "Integer": None, "Long": None}
FLOATING = frozenset("float double Float Double".split())
#: Characters behind a backslash (fixed values).
ESCAPES = {"n": 10, "t": 9, "r": 13, "b": 8, "f": 12, "s": 32, "0": 0, "'": 39, '"': 34, "\\": 92}
PRIMITIVES = frozenset("int long short byte char boolean float double void".split())
BINARY = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">=", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]
ASSIGNING = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
RET = "RET_VAR"
EXC = "EXC_VAR"
#: Types that a handler of everything names (fixed values).
CATCH_ALL = frozenset({"Throwable", "java.lang.Throwable"})


class Unsupported(Exception):
    """A form that the subset leaves out."""


class SyntaxFault(Exception):
    """Text that is no Java."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"no token at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


def number(text: str) -> float:
    raw = text.replace("_", "").rstrip("lL")
    if raw[:2].lower() == "0x":
        return float(int(raw, 16))
    if raw[:2].lower() == "0b":
        return float(int(raw, 2))
    if raw[:2].lower() == "0o":
        return float(int(raw[2:], 8))
    raw = raw.rstrip("fFdD")
    return float(int(raw, 8)) if len(raw) > 1 and raw[0] == "0" and raw.isdigit() else float(raw)


def is_floating(text: str) -> bool:
    """Whether a number's text is that of a float or double."""
    return text[:2].lower() not in ("0x", "0b", "0o") and bool(re.search(r"[.eEfFdD]", text))


def character(text: str) -> float | None:
    """The value of a character literal with its quotes; None for what is none."""
    inner = text[1:-1]
    if len(inner) == 1:
        return float(ord(inner))
    if re.fullmatch(r"\\u+[0-9a-fA-F]{4}", inner):
        return float(int(inner[-4:], 16))
    if re.fullmatch(r"\\[0-7]{1,3}", inner):
        return float(int(inner[1:], 8))
    return float(ESCAPES[inner[1]]) if len(inner) == 2 and inner[1] in ESCAPES else None


def simple(name: str) -> str:
    """The last part of a class name."""
    return re.split(r"[.$]", name)[-1]


def variables(e: list) -> set[str]:
    """Variables of an expression, array cells and lengths as dotted ones."""
    if e[0] in ("len", "cell"):
        return {f"{e[1]}.#"} | (variables(e[2]) if e[0] == "cell" else set())
    return {e[1]} if e[0] == "var" else {v for part in e[2:] if isinstance(part, list) for v in variables(part)}


class Parser:
    """One source file; ``methods`` and ``edges`` fill as it is read."""

    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0
        self.methods: list[dict] = []
        self.edges: list[tuple[str, int, int, str]] = []
        self.fields: list[tuple[str, str, bool]] = []
        self.hierarchy: list[tuple[str, str]] = []
        self.unsupported: list[tuple[str, str]] = []
        self.package = ""
        #: Types of fields and results by class and name, as far as they have been read; None where they differ.
        self.kinds: dict[tuple[str, str], str | None] = {}

    # --- tokens ------------------------------------------------------------

    def peek(self, k: int = 0) -> str:
        return self.toks[min(self.at + k, len(self.toks) - 1)][1]

    def kind(self, k: int = 0) -> str:
        return self.toks[min(self.at + k, len(self.toks) - 1)][0]

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if want is not None and got != want or self.kind() == "end":
            raise SyntaxFault(f"{want or 'more'} wanted, not {got!r}")
        self.at += 1
        return got

    def eat(self, want: str) -> bool:
        if self.peek() == want and self.kind() != "str":
            self.at += 1
            return True
        return False

    def skip_balanced(self, a: str, b: str) -> None:
        self.take(a)
        depth = 1
        while depth:
            got = self.take()
            depth += (got == a) - (got == b) if self.toks[self.at - 1][0] == "op" else 0

    def annotations(self) -> None:
        while self.peek() == "@" and self.peek(1) != "interface":
            self.take()
            self.name()
            if self.peek() == "(":
                self.skip_balanced("(", ")")

    def name(self) -> str:
        if self.kind() != "id":
            raise SyntaxFault(f"a name wanted, not {self.peek()!r}")
        parts = [self.take()]
        while self.peek() == "." and self.kind(1) == "id":
            self.take()
            parts.append(self.take())
        return ".".join(parts)

    def type_arguments(self) -> bool:
        """Skips <...> if it reads as type arguments."""
        if self.peek() != "<":
            return True
        start, depth = self.at, 0
        while True:
            got = self.peek()
            if got == "<":
                depth += 1
            elif got in (">", ">>", ">>>"):
                depth -= len(got)
            elif not (self.kind() == "id" or got in (",", ".", "?", "[", "]", "&")):
                self.at = start
                return False
            self.at += 1
            if depth <= 0:
                return depth == 0

    def type_(self) -> str | None:
        """A type, or None (and nothing read) if there is none here."""
        start = self.at
        if self.kind() != "id" or self.peek() in MODIFIERS:
            return None
        found = self.name()
        if not self.type_arguments():
            self.at = start
            return None
        while self.peek() == "[" and self.peek(1) == "]":
            self.at += 2
            found += "[]"
        return found

    # --- declarations ------------------------------------------------------

    def unit(self) -> None:
        while self.kind() != "end":
            self.annotations()
            if self.eat("package"):
                self.package = self.name()
                self.take(";")
            elif self.eat("import"):
                while not self.eat(";"):
                    self.take()
            elif not self.eat(";"):
                self.declaration(None)

    def modifiers(self) -> set[str]:
        found = set()
        while True:
            self.annotations()
            if self.peek() not in MODIFIERS:
                return found
            found.add(self.take())

    def declaration(self, outer: str | None) -> None:
        self.modifiers()
        form = self.take()
        if form in ("interface", "enum", "@"):
            while self.peek() != "{":
                self.take()
            self.unsupported.append((self.package, f"{form} declaration"))
            return self.skip_balanced("{", "}")
        if form != "class":
            raise SyntaxFault(f"a class wanted, not {form!r}")
        own = self.take()
        cls = f"{outer}${own}" if outer else f"{self.package}.{own}".lstrip(".")
        self.type_arguments()
        parent = self.type_() if self.eat("extends") else None
        if parent:
            self.hierarchy.append((cls, parent))
        if self.eat("implements"):
            while self.peek() != "{":
                kind = self.type_()
                if kind:
                    self.hierarchy.append((cls, kind))
                elif self.peek() != "{":
                    self.take()
        Class(self, cls, parent).body()

    def source(self) -> Parser:
        self.unit()
        return self


class Class:
    def __init__(self, p: Parser, name: str, parent: str | None = None):
        self.p, self.name, self.parent = p, name, parent
        self.fields: dict[str, bool] = {}
        #: Initial values (field, static, position) and blocks (None, static, position), in order.
        self.initial: list[tuple[str | None, bool, int]] = []

    def body(self) -> None:
        p = self.p
        p.take("{")
        start, members = p.at, []
        while not p.eat("}"):
            if p.eat(";"):
                continue
            if p.peek() == "{" or p.peek() == "static" and p.peek(1) == "{":
                static = p.eat("static")
                self.initial.append((None, static, p.at))
                p.skip_balanced("{", "}")
                continue
            at, mods = p.at, p.modifiers()
            if p.peek() in ("class", "interface", "enum", "@"):
                p.at = at
                p.declaration(self.name)
                continue
            p.type_arguments()
            self.member(mods, members)
        end = p.at
        for kind, at, data in members:
            if kind == "method":
                self.method(at, *data)
        if not any(k == "method" and d[0] == "<init>" for k, _, d in members):
            self.method(None, "<init>", False, [])
        if any(static for _, static, _ in self.initial):
            self.method(None, "<clinit>", True, [])
        p.at = end
        del start

    def member(self, mods: set[str], members: list) -> None:
        p = self.p
        ctor = p.kind() == "id" and p.peek(1) == "(" and p.peek() == re.split(r"[$.]", self.name)[-1]
        kind = None if ctor else p.type_()
        if not ctor and kind is None:
            raise SyntaxFault(f"a member wanted, not {p.peek()!r}")
        name = p.take()
        if p.peek() == "(":
            formals = self.formals()
            while p.peek() not in ("{", ";"):
                p.take()
            if p.peek() == ";":
                p.take()
                return
            known = p.kinds.setdefault((simple(self.name), f"{name}()"), kind)
            if known != kind:
                p.kinds[simple(self.name), f"{name}()"] = None
            members.append(("method", p.at, ("<init>" if ctor else name, "static" in mods, formals)))
            return p.skip_balanced("{", "}")
        while True:
            self.fields[name] = "static" in mods
            p.fields.append((self.name, name, "static" in mods))
            p.kinds[simple(self.name), name] = kind
            if p.eat("="):
                self.initial.append((name, "static" in mods, p.at))
                depth = 0
                while depth or p.peek() not in (",", ";"):
                    depth += (p.peek() in "([{") - (p.peek() in ")]}") if p.kind() == "op" else 0
                    p.take()
            if not p.eat(","):
                break
            name = p.take()
        p.take(";")

    def formals(self) -> list[tuple[str, str]]:
        p = self.p
        p.take("(")
        found = []
        while not p.eat(")"):
            p.modifiers()
            kind = p.type_()
            if p.eat("..."):
                kind = f"{kind}[]..."
            name = p.take()
            while p.peek() == "[":
                p.skip_balanced("[", "]")
            found.append((kind or "", name))
            p.eat(",")
        return found

    def method(self, at: int | None, name: str, static: bool, formals: list[tuple[str, str]]) -> None:
        p, save = self.p, self.p.at
        if at is not None:
            p.at = at
        try:
            Method(self, name, static, formals).run(at)
        except Unsupported as form:
            p.unsupported.append((f"{self.name}#{name}", str(form)))
        p.at = save


class Method:
    def __init__(self, cls: Class, name: str, static: bool, formals: list[tuple[str, str]]):
        self.c, self.p, self.name, self.static = cls, cls.p, name, static
        self.types = {n: t for t, n in formals}
        self.formals = [n for _, n in formals]
        self.id = f"{cls.name}#{name}({','.join(t.split('.')[-1] if not t.endswith('...') else t.removesuffix('...') for t, _ in formals)})"
        self.varargs = bool(formals) and formals[-1][0].endswith("...")
        self.count, self.temps = 3, 0  # 0 is the entry, 1 the exit, 2 the exceptional exit
        self.out: list[tuple[int, int, dict]] = []
        #: What break and continue can leave: label, place behind, place of the next turn, and whether a bare break means it.
        self.loops: list[tuple[str | None, int, int | None, bool]] = []
        #: Where exceptions go, and what runs on the way out: code, number of loops around it, handler around it.
        self.handler = 2
        self.finals: list[tuple[Callable[[int], int | None], int, int]] = []

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def emit(self, src: int, stmt: dict, dst: int | None = None) -> int:
        dst = self.new() if dst is None else dst
        self.out.append((src, dst, stmt))
        return dst

    def skip(self, src: int, dst: int) -> None:
        self.emit(src, {"k": "skip"}, dst)

    def temp(self) -> str:
        self.temps += 1
        return f"$t{self.temps}"

    def run(self, at: int | None) -> None:
        loc = 0
        p = self.p
        delegates = at is not None and [x for _, x in p.toks[at + 1 : at + 3]] == ["this", "("]
        if self.name in ("<init>", "<clinit>") and not delegates:
            for name, static, start in self.c.initial:
                if static == self.static and loc is not None:
                    p.at = start
                    if name is None:
                        loc = self.block(loc)
                    else:
                        loc, e = self.expr(loc)
                        loc = self.emit(loc, {"k": "assign", "lhs": f"{self.c.name if static else 'this'}.{name}", "e": e})
        if at is not None and loc is not None:
            p.at = at
            loc = self.block(loc)
        if loc is not None:
            self.skip(loc, 1)
        p.methods.append({"fn": self.id, "class_name": self.c.name, "method_name": self.name, "is_static": self.static, "formals": self.formals, "varargs": self.varargs, "entry": 0, "exit": 1, "exc_exit": 2})
        p.edges += [(self.id, s, d, json.dumps(x)) for s, d, x in self.out]

    # --- statements: from a location to the next one, None where control does not go on ---

    def block(self, loc: int | None) -> int | None:
        self.p.take("{")
        while not self.p.eat("}"):
            loc = self.statement(loc if loc is not None else self.new())  # unreachable code keeps its own island
        return loc

    def branch(self, loc: int, cond: list, truth: bool) -> int:
        return self.emit(loc, {"k": "assume", "e": cond if truth else ["un", "!", cond]})

    def statement(self, loc: int, label: str | None = None) -> int | None:
        p, word = self.p, self.p.peek()
        if p.kind() == "str":
            word = ""
        if label is not None and word not in ("while", "do", "for", "switch"):
            out = self.new()
            self.loops.append((label, out, None, False))
            end = self.statement(loc)
            self.loops.pop()
            if end is not None:
                self.skip(end, out)
            return out
        if word == "{":
            return self.block(loc)
        if word == ";":
            p.take()
            return self.emit(loc, {"k": "skip"})
        if p.kind() == "id" and p.peek(1) == ":" and p.peek(2) != ":":
            p.at += 2
            return self.statement(loc, word)
        if word == "if":
            p.take()
            loc, cond = self.parenthesised(loc)
            yes = self.statement(self.branch(loc, cond, True))
            no = self.branch(loc, cond, False)
            if p.eat("else"):
                no = self.statement(no)
            return self.merge(yes, no)
        if word in ("while", "do", "for"):
            return self.loop(p.take(), loc, label)
        if word == "switch":
            return self.switch(loc, label)
        if word in ("break", "continue"):
            p.take()
            name = p.take() if p.kind() == "id" else None
            p.take(";")
            for depth, (own, out, again, bare) in reversed(list(enumerate(self.loops))):
                if (bare if name is None else own == name) and (word == "break" or again is not None):
                    end = self.unwind(loc, depth)
                    if end is not None:
                        self.skip(end, out if word == "break" else again)
                    return None
            raise SyntaxFault(f"{word} outside of a loop")
        if word == "return":
            p.take()
            if p.peek() != ";":
                loc, e = self.expr(loc)
                loc = self.emit(loc, {"k": "assign", "lhs": RET, "e": e})
            p.take(";")
            end = self.unwind(loc, -1)
            if end is not None:
                self.skip(end, 1)
            return None
        if word == "throw":
            p.take()
            loc, e = self.expr(loc)
            p.take(";")
            self.emit(loc, {"k": "assign", "lhs": EXC, "e": e}, self.handler)
            return None
        if word == "try":
            return self.guarded(loc)
        if word == "assert":
            p.take()
            loc, e = self.expr(loc)
            while not p.eat(";"):
                p.take()
            return self.branch(loc, e, True)
        if word == "synchronized":
            p.take()
            loc, _ = self.parenthesised(loc)
            return self.block(loc)
        if word in ("yield", "class", "interface", "enum"):
            raise Unsupported(f"{word} statement")
        at = p.at
        p.modifiers()
        kind = p.type_()
        if kind and p.kind() == "id" and p.peek() != "instanceof" and p.peek(1) in ("=", ";", ",", "["):
            return self.locals(loc, kind)
        p.at = at
        loc, _ = self.expr(loc)
        p.take(";")
        return loc

    def unwind(self, loc: int | None, depth: int) -> int | None:
        """Runs what stands between here and the loop of that depth (-1: the end of the method)."""
        kept = self.finals, self.handler, self.loops, self.p.at
        self.finals = list(self.finals)
        while self.finals and self.finals[-1][1] > depth and loc is not None:
            run, around, self.handler = self.finals.pop()
            self.loops = self.loops[:around]
            loc = run(loc)
        self.finals, self.handler, self.loops, self.p.at = kept
        return loc

    def guarded(self, loc: int) -> int | None:
        """try with resources, handlers and a finally block."""
        p, outer = self.p, self.handler
        p.take("try")
        resources_at, body_at, handlers, final_at = None, p.at, [], None
        if p.peek() == "(":
            resources_at = p.at
            p.skip_balanced("(", ")")
            body_at = p.at
        p.skip_balanced("{", "}")
        while p.eat("catch"):
            handlers.append(p.at)
            p.skip_balanced("(", ")")
            p.skip_balanced("{", "}")
        if p.eat("finally"):
            final_at = p.at
            p.skip_balanced("{", "}")
        end_at = p.at

        def final(at: int) -> int | None:
            p.at = final_at
            return self.block(at)

        raised = outer
        if final_at is not None:
            raised = self.new()
            self.finals.append((final, len(self.loops), outer))
        self.handler = caught = self.new() if handlers else raised
        p.at = body_at if resources_at is None else resources_at
        ends = [self.block(loc) if resources_at is None else self.with_resources(loc, body_at)]
        self.handler, everything = raised, False
        for at in handlers:
            p.at = at
            p.take("(")
            p.modifiers()
            kinds = [p.type_()]
            while p.eat("|"):
                kinds.append(p.type_())
            name = p.take()
            p.take(")")
            self.types[name] = kinds[0] if len(kinds) == 1 else "Throwable"
            everything |= not CATCH_ALL.isdisjoint(kinds)
            ends.append(self.block(self.emit(caught, {"k": "assign", "lhs": name, "e": ["var", EXC]})))
        if handlers and not everything:
            self.skip(caught, raised)
        out = None
        for end in ends:
            out = self.merge(out, end)
        self.handler = outer
        if final_at is not None:
            self.finals.pop()
            out = None if out is None else final(out)
            thrown = self.temp()
            end = final(self.emit(raised, {"k": "assign", "lhs": thrown, "e": ["var", EXC]}))
            if end is not None:
                self.emit(end, {"k": "assign", "lhs": EXC, "e": ["var", thrown]}, outer)
        p.at = end_at
        return out

    def with_resources(self, loc: int, body_at: int) -> int | None:
        p, outer, names = self.p, self.handler, []
        p.take("(")
        while not p.eat(")"):
            p.modifiers()
            at, kind = p.at, p.type_()
            if kind and p.kind() == "id" and p.peek(1) == "=":
                names.append(p.take())
                self.types[names[-1]] = kind
                p.take("=")
                loc, e = self.expr(loc)
                loc = self.emit(loc, {"k": "assign", "lhs": names[-1], "e": e})
            else:
                p.at = at
                loc, e = self.expr(loc)
                loc, name = self.held(loc, e)
                names.append(name)
            p.eat(";")

        def close(at: int | None) -> int | None:
            for name in reversed(names):
                if at is not None:
                    at = self.invoke(at, {"k": "call", "lhs": None, "rcvr": name, "cls": self.types.get(name), "name": "close", "args": []})
            return at

        self.handler = raised = self.new()
        self.finals.append((close, len(self.loops), outer))
        p.at = body_at
        end = self.block(loc)
        self.finals.pop()
        self.handler = outer
        thrown = self.temp()
        self.emit(close(self.emit(raised, {"k": "assign", "lhs": thrown, "e": ["var", EXC]})), {"k": "assign", "lhs": EXC, "e": ["var", thrown]}, outer)
        return close(end)

    def switch(self, loc: int, label: str | None) -> int:
        """Both forms of cases; ``test`` is where all cases so far have failed, ``fall`` the end of the case before."""
        p = self.p
        p.take("switch")
        loc, e = self.parenthesised(loc)
        test, value = self.held(loc, e)
        out, default, fall = self.new(), None, None
        self.loops.append((label, out, None, True))
        p.take("{")
        while not p.eat("}"):
            if p.peek() not in ("case", "default"):
                fall = self.statement(fall if fall is not None else self.new())
                continue
            if p.take() == "default":
                default = inside = self.new()
            else:
                cond = None
                while True:
                    if p.kind() == "id" and p.peek(1) in (":", ",", "->", "."):
                        constant = self.variable(p.name())
                    else:
                        test, constant = self.binary(test, 0)
                    one = ["bin", "==", ["var", value], constant]
                    cond = one if cond is None else ["bin", "||", cond, one]
                    if not p.eat(","):
                        break
                inside, test = self.branch(test, cond, True), self.branch(test, cond, False)
            if p.eat("->"):
                end = self.statement(inside)
                if end is not None:
                    self.skip(end, out)
            else:
                p.take(":")
                fall = self.merge(inside, fall)
        self.loops.pop()
        if fall is not None:
            self.skip(fall, out)
        self.skip(test, out if default is None else default)
        return out

    def merge(self, a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        out = self.new()
        self.skip(a, out)
        self.skip(b, out)
        return out

    def locals(self, loc: int, kind: str) -> int:
        p = self.p
        while True:
            name = p.take()
            self.types[name] = kind
            while p.peek() == "[":
                p.skip_balanced("[", "]")
                self.types[name] += "[]"
            if p.eat("="):
                loc, e = self.expr(loc)
                loc = self.emit(loc, {"k": "assign", "lhs": name, "e": e})
            if not p.eat(","):
                break
        p.take(";")
        return loc

    def loop(self, form: str, loc: int, label: str | None) -> int:
        p = self.p
        out = self.new()
        if form == "do":
            head, test = self.new(), self.new()
            self.skip(loc, head)
            self.loops.append((label, out, test, True))
            end = self.statement(head)
            self.loops.pop()
            if end is not None:
                self.skip(end, test)
            p.take("while")
            at, cond = self.parenthesised(test)
            p.take(";")
            self.emit(at, {"k": "assume", "e": cond}, head)
            self.emit(at, {"k": "assume", "e": ["un", "!", cond]}, out)
            return out
        update_at, again = None, None
        if form == "for":
            p.take("(")
            at = p.at
            p.modifiers()
            if p.type_() and p.kind() == "id" and p.peek(1) == ":":
                p.at = at
                p.modifiers()
                kind, name = p.type_(), p.take()
                self.types[name] = kind
                p.take(":")
                loc, _ = self.expr(loc)
                p.take(")")
                head = self.new()
                self.skip(loc, head)
                self.skip(head, out)
                inside = self.emit(head, {"k": "assign", "lhs": name, "e": ["any"]})
                self.loops.append((label, out, head, True))
                end = self.statement(inside)
                self.loops.pop()
                if end is not None:
                    self.skip(end, head)
                return out
            p.at = at
            if not p.eat(";"):
                p.modifiers()
                kind = p.type_()
                if kind and p.kind() == "id" and p.peek(1) in ("=", ",", ";", "["):
                    loc = self.locals(loc, kind)
                else:
                    p.at = at
                    loc = self.expressions(loc, ";")
        head = self.new()
        self.skip(loc, head)
        if form == "for":
            at, cond = (head, ["lit", 1.0]) if p.peek() == ";" else self.expr(head)
            p.take(";")
            update_at, depth = p.at, 0
            while depth or p.peek() != ")":
                depth += (p.peek() == "(") - (p.peek() == ")")
                p.take()
            p.take(")")
            again = self.new()
        else:
            at, cond = self.parenthesised(head)
        inside = self.emit(at, {"k": "assume", "e": cond})
        self.emit(at, {"k": "assume", "e": ["un", "!", cond]}, out)
        self.loops.append((label, out, head if again is None else again, True))
        end = self.statement(inside)
        self.loops.pop()
        if again is None:
            if end is not None:
                self.skip(end, head)
            return out
        if end is not None:
            self.skip(end, again)
        after, p.at = p.at, update_at
        self.skip(self.expressions(again, ")"), head)
        p.at = after
        return out

    def expressions(self, loc: int, stop: str) -> int:
        while not self.p.eat(stop):
            loc, _ = self.expr(loc)
            self.p.eat(",")
        return loc

    # --- expressions: (location after side effects, value) ------------------

    def parenthesised(self, loc: int) -> tuple[int, list]:
        self.p.take("(")
        loc, e = self.expr(loc)
        self.p.take(")")
        return loc, e

    def pause(self, loc: int, e: list) -> tuple[int, tuple | None]:
        """A place behind an operand, which ``settle`` turns into a temporary if what comes next has effects."""
        if not variables(e):
            return loc, None
        mid = self.emit(loc, {"k": "skip"})
        return mid, (len(self.out) - 1, loc, mid)

    def settle(self, mark: tuple | None, at: int, e: list) -> tuple[int, list]:
        if mark is None:
            return at, e
        index, before, mid = mark
        if at == mid and len(self.out) == index + 1:
            self.out.pop()
            self.count -= 1
            return before, e
        between = [x for _, _, x in self.out[index + 1 :]]
        written = {x["lhs"] for x in between if x.get("lhs")}
        shared = any(x["k"] in ("call", "xcall", "store") for x in between) or any("." in n for n in written)
        if not any(n in written or "." in n and shared for n in variables(e)):
            return at, e  # nothing that it reads has been written
        name = self.temp()
        self.types[name] = self.kind(e)
        self.out[index] = (before, mid, {"k": "assign", "lhs": name, "e": e})
        return at, ["var", name]

    def kind(self, e: list) -> str | None:
        """The declared type of an expression, int, double or boolean of a computed one; None where it is not known."""
        tag = e[0]
        if tag == "lit":
            return "double" if len(e) > 2 else "int" if e[1] is not None else None
        if tag == "var":
            owner, _, field = e[1].rpartition(".")
            if not owner:
                return self.types.get(field)
            cls = self.c.name if owner == "this" else self.types.get(owner) or owner
            return self.p.kinds.get((simple(cls), field))
        if tag == "len":
            return "int"
        if tag == "cell":
            held = self.types.get(e[1]) or ""
            return held.removesuffix("...").removesuffix("[]") if "[]" in held else None
        if tag == "un":
            return "boolean" if e[1] == "!" else e[1][1:-1] if e[1][0] == "(" else self.kind(e[2])
        if tag != "bin":
            return None
        if e[1] in ("==", "!=", "<", "<=", ">", ">=", "&&", "||", "instanceof"):
            return "boolean"
        a, b = self.kind(e[2]), self.kind(e[3])
        if a in FLOATING or b in FLOATING:
            return "double"
        return "int" if e[1] == "//" or a in WHOLE and b in WHOLE else None

    def operation(self, op: str, left: list, right: list) -> list:
        """A binary operation; division by the types of its sides."""
        if op == "/":
            a, b = self.kind(left), self.kind(right)
            op = "/" if a in FLOATING or b in FLOATING else "//" if a in WHOLE and b in WHOLE else "/~"
        return ["bin", op, left, right]

    def cast(self, kind: str, e: list) -> list:
        """A cast that may change a number; others are erased."""
        own = self.kind(e)
        return ["un", f"({kind})", e] if kind in WHOLE and own != kind and not (own in WHOLE and kind in ("int", "long")) else e

    def expr(self, loc: int) -> tuple[int, list]:
        loc, left = self.ternary(loc)
        op = self.p.peek()
        if op not in ASSIGNING or self.p.kind() == "str":
            return loc, left
        self.p.take()
        if left[0] == "cell":
            loc, place = self.pause(loc, left[2])
        loc, value = self.pause(loc, left) if op != "=" else (loc, None)
        loc, right = self.expr(loc)
        loc, old = self.settle(value, loc, left)
        if left[0] == "cell":
            loc, index = self.settle(place, loc, left[2])
            old = [*left[:2], index] if old is left else old
            left = [*left[:2], index]
        own = self.kind(left)
        if op != "=":
            right = self.operation(op[:-1], old, right)
            if own in WHOLE:
                right = self.cast(own, right)
        return self.assign(loc, left, right), left

    def assign(self, loc: int, left: list, value: list) -> int:
        if left[0] == "var":
            return self.emit(loc, {"k": "assign", "lhs": left[1], "e": value})
        if left[0] == "cell":
            return self.emit(loc, {"k": "store", "arr": left[1], "index": left[2], "e": value})
        if left[0] == "len":  # a field of that name
            return self.emit(loc, {"k": "assign", "lhs": f"{left[1]}.length", "e": value})
        raise SyntaxFault("no variable to assign")

    def ternary(self, loc: int) -> tuple[int, list]:
        loc, cond = self.binary(loc, 0)
        if self.p.peek() != "?" or self.p.kind() == "str":
            return loc, cond
        self.p.take()
        name, ends = self.temp(), []
        for truth in (True, False):
            at, e = self.expr(self.branch(loc, cond, truth))
            ends.append(self.emit(at, {"k": "assign", "lhs": name, "e": e}))
            if truth:
                self.p.take(":")
        return self.merge(*ends), ["var", name]

    def binary(self, loc: int, level: int) -> tuple[int, list]:
        if level == len(BINARY):
            return self.unary(loc)
        loc, left = self.binary(loc, level + 1)
        while self.p.kind() != "str" and self.p.peek() in BINARY[level]:
            op = self.p.take()
            if op == "instanceof":
                self.p.modifiers()
                left = ["bin", op, left, ["type", self.p.type_() or ""]]
                if self.p.kind() == "id":
                    self.types[self.p.peek()] = left[3][1]
                    self.p.take()
                continue
            if op in ("&&", "||"):
                loc, left = self.short_circuit(loc, op, left, level + 1)
                continue
            loc, mark = self.pause(loc, left)
            loc, right = self.binary(loc, level + 1)
            loc, left = self.settle(mark, loc, left)
            left = self.operation(op, left, right)
        return loc, left

    def short_circuit(self, loc: int, op: str, left: list, level: int) -> tuple[int, list]:
        """A right side with statements of its own runs only where the left one asks for it."""
        start = len(self.out)
        inside = self.branch(loc, left, op == "&&")
        at, right = self.binary(inside, level)
        if at == inside:
            self.out.pop()
            return loc, ["bin", op, left, right]
        name = self.temp()
        written = {x.get("lhs") for _, _, x in self.out[start:]}
        ends = [self.emit(at, {"k": "assign", "lhs": name, "e": right})]
        ends.append(self.emit(self.branch(loc, left, op != "&&"), {"k": "assign", "lhs": name, "e": ["lit", float(op == "||")]}))
        names = variables(left)
        steady = not any("." in n or n in written for n in names)
        return self.merge(*ends), ["bin", op, left, ["var", name]] if steady else ["var", name]

    def unary(self, loc: int) -> tuple[int, list]:
        p, op = self.p, self.p.peek()
        if p.kind() == "op" and op in ("+", "-", "!", "~"):
            p.take()
            loc, e = self.unary(loc)
            return loc, ["un", op, e]
        if p.kind() == "op" and op in ("++", "--"):
            p.take()
            loc, e = self.unary(loc)
            return self.assign(loc, e, ["bin", op[0], e, ["lit", 1.0]]), e
        if op == "(" and p.kind(1) == "id":
            at = p.at
            p.take()
            kind = p.type_()
            if kind and p.eat(")") and (kind in PRIMITIVES or p.kind() in ("id", "num", "str") and p.peek() != "instanceof" or p.peek() in ("(", "!", "~")):
                loc, e = self.unary(loc)
                return loc, self.cast(kind, e)
            p.at = at
        return self.postfix(loc)

    def arguments(self, loc: int) -> tuple[int, list]:
        self.p.take("(")
        args, marks = [], []
        while not self.p.eat(")"):
            if args:
                loc, mark = self.pause(loc, args[-1])
                marks.append(mark)
            loc, e = self.expr(loc)
            args.append(e)
            self.p.eat(",")
        for i in range(len(marks) - 1, -1, -1):
            loc, args[i] = self.settle(marks[i], loc, args[i])
        return loc, args

    def call(self, loc: int, rcvr: str | None, cls: str | None, name: str, exact: bool = False) -> tuple[int, list]:
        loc, args = self.arguments(loc)
        lhs = self.temp()
        self.types[lhs] = self.p.kinds.get((simple(cls), f"{name}()")) if cls else None
        return self.invoke(loc, {"k": "call", "lhs": lhs, "rcvr": rcvr, "cls": cls, "name": name, "args": args, "exact": exact or rcvr is None or name == "<init>"}), ["var", lhs]

    def invoke(self, loc: int, stmt: dict) -> int:
        stmt = {"exact": stmt["name"] == "<init>"} | stmt
        self.emit(loc, stmt | {"k": "xcall"}, self.handler)
        return self.emit(loc, stmt)

    def array(self, loc: int, size: list, cells: list | None = None, kind: str | None = None) -> tuple[int, list]:
        """A new array in a temporary, with its length and, of a literal, its cells."""
        name = self.temp()
        self.types[name] = kind
        loc = self.emit(loc, {"k": "assign", "lhs": name, "e": ["obj"]})
        loc = self.emit(loc, {"k": "assign", "lhs": f"{name}.#len", "e": size})
        for i, e in enumerate(cells or ()):
            loc = self.emit(loc, {"k": "assign", "lhs": f"{name}.#{i}", "e": e})
        return loc, ["var", name]

    def literal(self, loc: int) -> tuple[int, list]:
        self.p.take("{")
        cells = []
        while not self.p.eat("}"):
            loc, e = self.expr(loc)
            cells.append(e)
            self.p.eat(",")
        return self.array(loc, ["lit", float(len(cells))], cells)

    def variable(self, name: str) -> list:
        if name in self.types:
            return ["var", name]
        if name in self.c.fields:
            return ["var", f"{self.c.name}.{name}" if self.c.fields[name] else f"this.{name}"]
        return ["var", name]

    def held(self, loc: int, e: list) -> tuple[int, str]:
        """The value in a variable."""
        if e[0] == "var":
            return loc, e[1]
        name = self.temp()
        self.types[name] = self.kind(e)
        return self.emit(loc, {"k": "assign", "lhs": name, "e": e}), name

    def postfix(self, loc: int) -> tuple[int, list]:
        p = self.p
        loc, e = self.primary(loc)
        while p.kind() == "op":
            op = p.peek()
            if op == "." and p.kind(1) == "id":
                p.take()
                p.type_arguments()
                name = p.take()
                if name == "class":
                    e = ["obj"]
                elif p.peek() == "(":
                    loc, rcvr = self.held(loc, e)
                    known = self.types.get(rcvr)
                    as_class = e[0] == "var" and known is None and rcvr[:1].isupper() and "." not in rcvr
                    if rcvr == "this":
                        known = self.c.name
                    if rcvr == "super":
                        loc, e = self.call(loc, "this", self.c.parent or "Object", name, True)
                    else:
                        loc, e = self.call(loc, None if as_class else rcvr, rcvr if as_class else known, name)
                else:
                    loc, rcvr = self.held(loc, e)
                    e = ["len", rcvr] if name == "length" else ["var", f"{rcvr}.{name}"]
            elif op == "[":
                p.take()
                loc, arr = self.held(loc, e)
                loc, index = self.expr(loc)
                p.take("]")
                e = ["cell", arr, index]
            elif op in ("++", "--"):
                p.take()
                loc = self.assign(loc, e, ["bin", op[0], e, ["lit", 1.0]])
                e = ["bin", "-" if op == "++" else "+", e, ["lit", 1.0]]
            elif op == "::":
                p.take()
                p.type_arguments()
                p.take()
                e = ["obj"]  # a reference is an object; it runs nothing here
            elif op == "->" and p.toks[p.at - 1][1] == ")":  # an arrow behind anything else ends a label
                raise Unsupported("lambda")
            else:
                break
        return loc, e

    def primary(self, loc: int) -> tuple[int, list]:
        p, kind, word = self.p, self.p.kind(), self.p.peek()
        if kind == "num":
            text = p.take()
            return loc, ["lit", number(text), *(["f"] if is_floating(text) else [])]
        if kind == "str":
            text = p.take()
            code = character(text) if text[0] == "'" else None
            return loc, ["obj"] if code is None else ["lit", code]
        if word == "(":
            at = p.at
            p.skip_balanced("(", ")")
            if p.peek() == "->":
                raise Unsupported("lambda")
            p.at = at
            return self.parenthesised(loc)
        if word == "{":
            return self.literal(loc)
        if kind != "id":
            raise SyntaxFault(f"an expression wanted, not {word!r}")
        p.take()
        if word in ("true", "false"):
            return loc, ["lit", float(word == "true")]
        if word == "null":
            return loc, ["lit", None]
        if word == "switch":
            raise Unsupported("switch expression")
        if word == "new":
            made = p.name()
            p.type_arguments()
            if p.peek() == "(":
                loc, args = self.arguments(loc)
                if p.peek() == "{":
                    raise Unsupported("anonymous class")
                name = self.temp()
                self.types[name] = made
                loc = self.emit(loc, {"k": "assign", "lhs": name, "e": ["obj", "new"]})
                return self.invoke(loc, {"k": "call", "lhs": None, "rcvr": name, "cls": made, "name": "<init>", "args": args}), ["var", name]
            size, made = None, f"{made}[]"
            while p.peek() == "[":
                p.take()
                if p.peek() != "]":
                    loc, e = self.expr(loc)
                    size = e if size is None else size  # of the outermost dimension
                p.take("]")
            return self.literal(loc) if p.peek() == "{" else self.array(loc, size or ["any"], kind=made)
        if word in ("this", "super") and p.peek() == "(":
            loc, args = self.arguments(loc)
            made = self.c.name if word == "this" else self.c.parent
            return loc if made is None else self.invoke(loc, {"k": "call", "lhs": None, "rcvr": "this", "cls": made, "name": "<init>", "args": args}), ["any"]
        if p.peek() == "->":
            raise Unsupported("lambda")
        if p.peek() == "(":
            return self.call(loc, None if self.static else "this", self.c.name, word)
        return loc, self.variable(word)


def parse_sources(files: DataFrame) -> DataFrame:
    """``files(path, text)`` -> rows ``(path, kind, data)`` with kind method, edge, field, parent, unsupported or error.

    Every file is parsed for itself, so this is one pass over the sources.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    p = Parser(text or "").source()
                except (SyntaxFault, RecursionError) as fault:
                    rows.append((path, "error", json.dumps(str(fault))))
                    continue
                rows += [(path, "method", json.dumps(m)) for m in p.methods]
                rows += [(path, "edge", json.dumps({"fn": f, "src": s, "dst": d, "stmt": x})) for f, s, d, x in p.edges]
                rows += [(path, "field", json.dumps({"class_name": c, "name": n, "is_static": s})) for c, n, s in p.fields]
                rows += [(path, "parent", json.dumps({"child": a, "parent": b})) for a, b in p.hierarchy]
                rows += [(path, "unsupported", json.dumps({"fn": f, "form": x})) for f, x in p.unsupported]
            yield pd.DataFrame(rows, columns=["path", "kind", "data"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(run, "path string, kind string, data string")


SCHEMAS = {
    "method": "fn string, class_name string, method_name string, is_static boolean, formals array<string>, varargs boolean, entry long, exit long, exc_exit long",
    "edge": "fn string, src long, dst long, stmt string",
    "field": "class_name string, name string, is_static boolean",
    "parent": "child string, parent string",
    "unsupported": "fn string, form string",
}


def facts_of(parsed: DataFrame, kind: str) -> DataFrame:
    """One table of the parsed facts."""
    return parsed.where(F.col("kind") == kind).select("path", F.from_json("data", SCHEMAS[kind]).alias("d")).select("path", "d.*")
