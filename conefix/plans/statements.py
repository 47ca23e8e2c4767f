"""Statement-level differences between two versions of a method.

A method's body becomes a tree of statements by its tokens: plain ones, and ifs, loops,
switches and tries with a header and bodies. Two lists of statements are aligned by a longest common
subsequence; what lies between common statements is one edit: added, deleted or modified
statements. Compound statements of equal headers among them are compared inside. An edit names where it is: the path of positions in the old tree.

Methods of one version only, or with other headers, are edits of whole methods. Null sources
are empty; a source that does not parse has one row of kind ``error``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.operators.textdiff import matches
from conefix.session import ship
from conefix.sources.java import SyntaxFault, tokens

EDITS = "program string, method string, kind string, place string, old int, new int, text string"
_HEADED = frozenset("if while for switch synchronized catch".split())
_BARE = frozenset("else do try finally".split())

Tree = list


class _Reader:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def peek(self) -> str:
        kind, text = self.toks[self.at]
        return text if kind != "str" else f"\0{text}"

    def take(self) -> str:
        kind, text = self.toks[self.at]
        if kind == "end":
            raise SyntaxFault("the source breaks off")
        self.at += 1
        return text

    def until(self, stops: str) -> list[str]:
        """Tokens up to one of ``stops`` outside of brackets, which is not taken."""
        out, depth = [], 0
        while depth or self.peek() not in stops:
            op = self.peek()
            depth += (op in ("(", "[", "{")) - (op in (")", "]", "}"))
            out.append(self.take())
        return out

    def balanced(self) -> list[str]:
        out, depth = [self.take()], 1
        while depth:
            op = self.peek()
            depth += (op in ("(", "[", "{")) - (op in (")", "]", "}"))
            out.append(self.take())
        return out

    def block(self) -> Tree:
        """Statements between braces, or a single one."""
        if self.peek() != "{":
            return [self.statement()]
        self.take()
        out = []
        while self.peek() != "}":
            out.append(self.statement())
        self.take()
        return out

    def statement(self) -> Tree:
        """``[text]`` of a plain statement, ``[text, bodies]`` of a compound one."""
        word = self.peek()
        if word == "{":
            return ["{}", [self.block()]]
        if word in _HEADED or word in _BARE:
            head = [self.take()]
            if word in _HEADED or word == "try" and self.peek() == "(":
                head += self.balanced()
            bodies = [self.block()]
            while self.peek() in ("else", "catch", "finally") and word in ("if", "try") or word == "do" and self.peek() == "while":
                head.append(self.take())
                if head[-1] in ("catch", "while"):
                    head += self.balanced()
                if head[-1] == ")" and word == "do":
                    self.take()
                    break
                bodies.append(self.block())
            return [" ".join(head), bodies]
        text = self.until(";:")
        text.append(self.take())
        return [" ".join(text)]


def methods_of(source: str) -> dict[str, tuple[str, Tree]]:
    """``class#name/arity`` -> header and statements of every method with a body."""
    reader, out = _Reader(source), {}

    def members(owner: str) -> None:
        while reader.peek() != "}":
            if reader.peek() == ";":
                reader.take()
                continue
            head = reader.until("{;=}")
            if reader.peek() == "=":
                reader.until(";")
                reader.take()
            elif reader.peek() == ";":
                reader.take()
            elif "interface" in head or "enum" in head:
                reader.balanced()
            elif "class" in head:
                reader.take()
                members(f"{owner}${head[head.index('class') + 1]}")
                reader.take()
            else:
                name, formals = "{}", []
                if "(" in head:
                    at = head.index("(")
                    name, formals = head[at - 1], head[at + 1 : len(head) - 1 - head[::-1].index(")")]
                body = reader.block()
                if "(" in head:
                    out[f"{owner}#{name}/{formals.count(',') + bool(formals)}"] = (" ".join(head), body)

    while reader.toks[reader.at][0] != "end":
        head = reader.until("{;")
        if "interface" in head or "enum" in head:
            reader.balanced()
            continue
        reader.take()
        if "class" in head:
            members(head[head.index("class") + 1])
            reader.take()
    return out


def edits_of(old: Tree, new: Tree, path: str = "") -> Iterator[tuple[str, str, int, int, str]]:
    """``(kind, place, old statements, new statements, new text)`` of the edits that make ``new`` of ``old``."""
    whole = lambda s: json.dumps(s)
    frame = lambda s: json.dumps([s[0], len(s[1]) if len(s) > 1 else -1])
    i = j = 0
    for x, y in [*matches([*map(whole, old)], [*map(whole, new)]), (len(old), len(new))]:
        # Between common statements, compound ones of equal headers are compared inside.
        inner = matches([*map(frame, old[i:x])], [*map(frame, new[j:y])])
        p, q = i, j
        for u, v in [*((i + u, j + v) for u, v in inner), (x, y)]:
            if u > p or v > q:
                kind = "add_statements" if u == p else "delete_statements" if v == q else "modify_statements"
                yield kind, f"{path}{p}", u - p, v - q, " ".join(s[0] for s in new[q:v])
            if u < x or v < y:
                for n, (one, other) in enumerate(zip(old[u][1], new[v][1], strict=True)):
                    yield from edits_of(one, other, f"{path}{u}.{n}/")
            p, q = u + 1, v + 1
        i, j = x + 1, y + 1


def statement_edits(previous: DataFrame, following: DataFrame) -> DataFrame:
    """``(program, text)`` of two versions -> rows ``EDITS``; unchanged programs and methods have none."""
    a, b = previous.select("program", F.coalesce("text", F.lit("")).alias("a")), following.select("program", F.coalesce("text", F.lit("")).alias("b"))
    pairs = a.join(b, "program", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for program, x, y in zip(batch["program"], batch["a"], batch["b"], strict=True):
                try:
                    old, new = methods_of(x or ""), methods_of(y or "")
                except (SyntaxFault, IndexError) as fault:
                    rows.append((program, None, "error", None, None, None, str(fault)))
                    continue
                for name in sorted(old.keys() | new.keys()):
                    if name not in old or name not in new:
                        rows.append((program, name, "add_function" if name in new else "delete_function", "", None, None, (new.get(name) or old[name])[0]))
                    elif old[name][0] != new[name][0]:
                        rows.append((program, name, "modify_header", "", None, None, new[name][0]))
                    else:
                        rows += [(program, name, *e) for e in edits_of(old[name][1], new[name][1])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDITS.split(", ")]).astype({"old": "Int32", "new": "Int32"})

    ship(previous.sparkSession)
    return pairs.mapInPandas(run, EDITS)
