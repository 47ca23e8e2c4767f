"""Abstract states stored once under their digest, and joins of them remembered.

A state is a set of rows (var, lo, hi); its digest names it whatever owns it. Joins and
widenings are asked for as pairs of digests: those that are known are looked up, the others are
computed once for all who ask, and their results are interned and kept. The tables live
in the shared folder and are added to, never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.functions.interval import Itv
from conefix.operators.states import state_id
from conefix.session import Scratch


class Interned:
    """Tables of different states ``(digest, var, lo, hi)`` and of known pairs ``(op, a, b, digest)``."""

    def __init__(self, spark):
        self.spark, self.scratch = spark, Scratch(spark, "interned")
        self.states: DataFrame | None = None
        self.pairs: DataFrame | None = None
        self.turn = self.hits = self.misses = 0

    def _add(self, name: str, rows: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
        fresh = rows if known is None else rows.join(known.select(*keys).distinct(), keys, "left_anti")
        self.turn += 1
        part = self.scratch.save(fresh, f"{name}-{self.turn}")
        return part if known is None else known.unionByName(part)

    def intern(self, states: DataFrame, owner: list[str]) -> DataFrame:
        """``states(owner..., var, lo, hi)`` -> ``(owner..., digest)``; states that are new are stored."""
        named = self.scratch.save(states.groupBy(*owner).agg(state_id(F.col("var"), F.col("lo"), F.col("hi")).alias("digest")), f"named-{self.turn}")
        rows = states.join(named, owner).select("digest", "var", "lo", "hi").distinct()
        self.states = self._add("states", rows, self.states, ["digest"])
        return named

    def combined(self, asked: DataFrame, op: str = "join") -> DataFrame:
        """``asked(a, b, ...)`` of digests, ``op`` join or widen -> the same rows with ``digest`` of the result; ``hits`` and ``misses`` count different pairs."""
        wanted = self.scratch.save(asked.select(F.lit(op).alias("op"), "a", "b").distinct(), f"wanted-{self.turn}")
        lacking = wanted if self.pairs is None else wanted.join(self.pairs.select("op", "a", "b"), ["op", "a", "b"], "left_anti")
        lacking = self.scratch.save(lacking, f"lacking-{self.turn}")
        new = lacking.count()
        self.misses += new
        self.hits += wanted.count() - new
        if new or self.pairs is None:
            left, right = (self.states.select(F.col("digest").alias(x), "var", F.struct("lo", "hi").alias(f"\0{x}")) for x in "ab")
            met = lacking.join(left, "a").join(right, ["b", "var"])  # variables that either leaves open are open
            lo, hi = self._result(op, Itv(F.col("\0a.lo"), F.col("\0a.hi")), Itv(F.col("\0b.lo"), F.col("\0b.hi")))
            rows = self.scratch.save(met.select("op", "a", "b", "var", lo.alias("lo"), hi.alias("hi")), f"results-{self.turn}")
            named = self.intern(rows, ["op", "a", "b"])
            # Pairs without a variable in common give the state that leaves everything open.
            open_ = lacking.join(named.select("op", "a", "b"), ["op", "a", "b"], "left_anti").withColumn("digest", F.lit(None).cast("string"))
            self.pairs = self._add("pairs", named.select("op", "a", "b", "digest").unionByName(open_), self.pairs, ["op", "a", "b"])
        return asked.join(self.pairs.where(F.col("op") == op).drop("op"), ["a", "b"])

    @staticmethod
    def _result(op: str, a: Itv, b: Itv) -> tuple[Column, Column]:
        got = a.join(b) if op == "join" else a.widen(b)
        return got.lo, got.hi

    def rows(self, named: DataFrame) -> DataFrame:
        """``named(..., digest)`` with the rows of its states."""
        return named.join(self.states, "digest")
