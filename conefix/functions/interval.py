"""Interval arithmetic on bound columns: lattice operations, evaluation, and refinement by comparisons.

An interval is a pair of DOUBLE columns (lo, hi), infinite where unconstrained;
lo > hi is the empty interval (bottom). All of it stays in native expressions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

POS, NEG = float("inf"), float("-inf")
#: Distance by which a strict comparison of boxes moves a bound.
STRICT = 1e-10


class Itv(NamedTuple):
    lo: Column
    hi: Column

    @staticmethod
    def of(lo: str | float | Column, hi: str | float | Column | None = None) -> Itv:
        a = F.col(lo) if isinstance(lo, str) else lo if isinstance(lo, Column) else F.lit(float(lo))
        return Itv(a, a) if hi is None else Itv(a, Itv.of(hi).lo)

    @staticmethod
    def top() -> Itv:
        return Itv(F.lit(NEG), F.lit(POS))

    def is_bottom(self) -> Column:
        return self.lo > self.hi

    def is_top(self) -> Column:
        return (self.lo == NEG) & (self.hi == POS)

    def contains(self, value: float) -> Column:
        return (self.lo <= value) & (self.hi >= value)

    # --- lattice -----------------------------------------------------------

    def join(self, other: Itv) -> Itv:
        return Itv(F.least(self.lo, other.lo), F.greatest(self.hi, other.hi))

    def meet(self, other: Itv) -> Itv:
        return Itv(F.greatest(self.lo, other.lo), F.least(self.hi, other.hi))

    def widen(self, new: Itv) -> Itv:
        """Old widened by new: a bound that moved becomes infinite. Not commutative."""
        return Itv(F.when(new.lo < self.lo, F.lit(NEG)).otherwise(self.lo), F.when(new.hi > self.hi, F.lit(POS)).otherwise(self.hi))

    def implies(self, other: Itv) -> Column:
        return (self.lo >= other.lo) & (self.hi <= other.hi)

    # --- evaluation --------------------------------------------------------

    def _corners(self, other: Itv, op) -> Itv:
        four = [_defined(op(a, b)) for a in self for b in other]
        return Itv(F.least(*four), F.greatest(*four))

    def add(self, other: Itv) -> Itv:
        return Itv(self.lo + other.lo, self.hi + other.hi)

    def sub(self, other: Itv) -> Itv:
        return Itv(self.lo - other.hi, self.hi - other.lo)

    def neg(self) -> Itv:
        return Itv(-self.hi, -self.lo)

    def mul(self, other: Itv) -> Itv:
        return self._corners(other, lambda a, b: a * b)

    def div(self, other: Itv) -> Itv:
        """Unconstrained where the divisor may be zero."""
        zero = other.contains(0.0)
        safe = Itv(F.when(zero, F.lit(1.0)).otherwise(other.lo), F.when(zero, F.lit(1.0)).otherwise(other.hi))
        got = self._corners(safe, lambda a, b: a / b)
        return Itv(F.when(zero, F.lit(NEG)).otherwise(got.lo), F.when(zero, F.lit(POS)).otherwise(got.hi))

    def mod(self, other: Itv) -> Itv:
        """Remainder with the sign of the dividend; unconstrained where the divisor may be zero."""
        zero = other.contains(0.0)
        most = F.greatest(F.abs(other.lo), F.abs(other.hi))
        lo = F.when(self.lo >= 0, F.lit(0.0)).otherwise(F.greatest(self.lo, -most))
        hi = F.when(self.hi <= 0, F.lit(0.0)).otherwise(F.least(self.hi, most))
        return Itv(F.when(zero, F.lit(NEG)).otherwise(lo), F.when(zero, F.lit(POS)).otherwise(hi))

    def shift_left(self, other: Itv) -> Itv:
        return self.mul(Itv(F.pow(F.lit(2.0), other.lo), F.pow(F.lit(2.0), other.hi)))

    def shift_right(self, other: Itv) -> Itv:
        return self.div(Itv(F.pow(F.lit(2.0), other.lo), F.pow(F.lit(2.0), other.hi)))

    # --- comparisons -------------------------------------------------------

    def compare(self, op: str, other: Itv) -> Column:
        """True, false, or null where both are possible."""
        a, b = self, other
        if op in (">", ">="):
            return b.compare("<" if op == ">" else "<=", a)
        if op == "<":
            sure, never = a.hi < b.lo, a.lo >= b.hi
        elif op == "<=":
            sure, never = a.hi <= b.lo, a.lo > b.hi
        else:
            same, apart = (a.lo == a.hi) & (b.lo == b.hi) & (a.lo == b.lo), (a.hi < b.lo) | (a.lo > b.hi)
            sure, never = (same, apart) if op == "==" else (apart, same)
        return F.when(sure, F.lit(True)).when(never, F.lit(False))

    def assume(self, op: str, other: Itv) -> Itv:
        """This interval where ``self op other`` holds; empty where it cannot."""
        if op == "==":
            return self.meet(other)
        if op == "!=":
            at_lo = (other.lo == other.hi) & (self.lo == other.lo)
            at_hi = (other.lo == other.hi) & (self.hi == other.hi)
            return Itv(F.when(at_lo, self.lo + STRICT).otherwise(self.lo), F.when(at_hi, self.hi - STRICT).otherwise(self.hi))
        if op in ("<", "<="):
            return self.meet(Itv(F.lit(NEG), other.hi - (STRICT if op == "<" else 0.0)))
        return self.meet(Itv(other.lo + (STRICT if op == ">" else 0.0), F.lit(POS)))


#: The comparison that holds where another one does not, and the one with its sides exchanged.
NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def _defined(value: Column) -> Column:
    """A corner; an infinite bound times zero is zero."""
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(value)


def in_bounds(index: Itv, length: Itv) -> Column:
    """Whether an array access is safe: true, false (it never is), or null where unknown."""
    return F.when((index.lo >= 0) & (index.hi < length.lo), F.lit(True)).when((index.hi < 0) | (index.lo >= length.hi), F.lit(False))


# --- logic and literals ------------------------------------------------------


def truth(holds: Column) -> Itv:
    """A three-valued comparison as a number: 1, 0, or either."""
    return Itv(F.when(holds, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(~holds, F.lit(0.0)).otherwise(F.lit(1.0)))


def both(a: Itv, b: Itv) -> Itv:
    """Logical and of truth values: the lesser."""
    return Itv(F.least(a.lo, b.lo), F.least(a.hi, b.hi))


def either(a: Itv, b: Itv) -> Itv:
    """Logical or: the greater."""
    return Itv(F.greatest(a.lo, b.lo), F.greatest(a.hi, b.hi))


def negated(a: Itv) -> Itv:
    return Itv(1.0 - a.hi, 1.0 - a.lo)


def bitwise_and(a: Itv, b: Itv) -> Itv:
    """Of whole numbers: within the lesser one where neither is negative, else unconstrained."""
    known = (a.lo >= 0) & (b.lo >= 0)
    return Itv(F.when(known, F.lit(0.0)).otherwise(F.lit(NEG)), F.when(known, F.least(a.hi, b.hi)).otherwise(F.lit(POS)))


def bitwise_or(a: Itv, b: Itv) -> Itv:
    """Of whole numbers: at least the greater one and at most their sum where neither is negative."""
    known = (a.lo >= 0) & (b.lo >= 0)
    return Itv(F.when(known, F.greatest(a.lo, b.lo)).otherwise(F.lit(NEG)), F.when(known, a.hi + b.hi).otherwise(F.lit(POS)))


def literal(text: Column) -> Column:
    """The number of a literal: whole in base 10, 16, 8 or 2, with a fraction or exponent, a character, true or false; null for others."""
    plain = F.regexp_replace(F.lower(text), "_", "")
    digits = F.regexp_replace(plain, "l$", "")
    based = lambda n, b: F.conv(F.substring(digits, n + 1, 64), b, 10).cast("double")
    return (
        F.when(plain == "true", F.lit(1.0))
        .when(plain == "false", F.lit(0.0))
        .when(text.rlike("^'.'$"), F.ascii(F.substring(text, 2, 1)).cast("double"))
        .when(digits.rlike("^0x[0-9a-f]+$"), based(2, 16))
        .when(digits.rlike("^0b[01]+$"), based(2, 2))
        .when(digits.rlike("^0[0-7]+$"), based(1, 8))
        .when(digits.rlike("^[0-9]+$"), digits.try_cast("double"))
        .when(plain.rlike(r"^([0-9]+\.[0-9]*|\.?[0-9]+)(e[+-]?[0-9]+)?[fd]?$"), F.regexp_replace(plain, "[fd]$", "").try_cast("double"))
    )
