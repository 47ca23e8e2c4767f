"""Line diffs of changed files by unique common lines, as hunks.

Lines that occur once in both versions anchor the diff: the longest chain of anchors that
rises in both is kept, and what lies between two anchors is compared again. Where no
anchor is left, lines pair up by a longest common subsequence, by halves in linear space
where the stretch is large. Each changed file is a group of its own; unchanged files never
reach it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Old lines x new lines up to which the whole table of common lengths is held.
TABLE_CELLS = 4_000_000
#: Occurrences from which the places of a line are kept as one number of bits.
KEPT_PLACES = 64
HUNKS = "path string, prev_start int, prev_len int, next_start int, new_lines array<string>"


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that rises in both parts, from pairs that rise in the first."""
    tails, ends, links = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        tails[k : k + 1], ends[k : k + 1] = [b], [i]
        links[i] = ends[k - 1] if k else -1
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(pairs[i])
        i = links[i]
    return chain[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two short lists."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of a longest common subsequence of a and each beginning of b, a row of bits at a time."""
    n = len(b)
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    kept: dict[str, int] = {}
    full = row = (1 << n) - 1
    for line in a:
        if line not in places:
            continue
        mask = kept.get(line)
        if mask is None:
            bits = bytearray(-(-n // 8))
            for j in places[line]:
                bits[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(bits, "little")
            if len(places[line]) >= KEPT_PLACES:
                kept[line] = mask
        both = row & mask
        row = ((row + both) | (row - both)) & full
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), dtype=np.uint8), bitorder="little")[:n].astype(np.int64)
    return np.append(0, np.cumsum(zeros))


def _common_by_halves(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of lists of any length (Hirschberg)."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        if i == m or j == n:
            continue
        if m - i == 1:
            out += [(i, j + k) for k in [k for k, line in enumerate(b[j:n]) if line == a[i]][:1]]
        elif (m - i) * (n - j) <= TABLE_CELLS:
            out += [(i + x, j + y) for x, y in _common(a[i:m], b[j:n])]
        else:
            half = (i + m) // 2
            both = _lengths(a[i:half], b[j:n]) + _lengths(a[half:m][::-1], b[j:n][::-1])[::-1]
            cut = j + int(both.argmax())
            work += [(i, half, j, cut), (half, m, cut, n)]
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines that rise in both lists."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        place = {line: k + j for k, line in enumerate(b[j:n]) if once_b[line] == 1}
        anchors = _rising([(k, place[a[k]]) for k in range(i, m) if once_a[a[k]] == 1 and a[k] in place])
        if anchors:
            for x, y in [*anchors, (m, n)]:
                work.append((i, x, j, y))
                if x < m or y < n:
                    out.append((x, y))
                i, j = x + 1, y + 1
        else:
            out += [(i + x, j + y) for x, y in _common_by_halves(a[i:m], b[j:n])]
    return sorted(out)


def hunks(a: list[str], b: list[str]) -> list[tuple[int, int, int, list[str]]]:
    """(first old line, old lines, first new line, new lines) of each change, lines from 0."""
    out, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, x - i, j, b[j:y]))
        i, j = x + 1, y + 1
    return out


def diff(previous: DataFrame, following: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Hunks of the files that both versions have with different texts."""
    a, b = previous.select(F.col(path).alias("path"), F.col(text).alias("a")), following.select(F.col(path).alias("path"), F.col(text).alias("b"))
    changed = a.join(b, "path").where("a != b")

    def run(batches):
        for batch in batches:
            rows = [(p, *h) for p, x, y in zip(batch["path"], batch["a"], batch["b"], strict=True) for h in hunks(x.split("\n"), y.split("\n"))]
            yield pd.DataFrame(rows, columns=["path", "prev_start", "prev_len", "next_start", "new_lines"])

    return changed.mapInPandas(run, HUNKS)
