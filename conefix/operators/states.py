"""Abstract states as long tables, a row for each state and variable.

Numeric states: a variable without a row is unconstrained, so a join keeps the
variables that all states have (inner), a meet those that any has (outer).
Nullness and address states: a missing key means no information yet, so a join keeps
all keys (outer). Bottom is never "no rows" of a numeric state; it is a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conefix.functions.interval import Itv


def join_numeric(states: DataFrame, group: list[str], state: str, var: str = "var", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Join of the states of each group: ``group + (var, lo, hi)``, only variables of all its states."""
    members = states.groupBy(*group).agg(F.countDistinct(state).alias("\0members"))
    merged = states.groupBy(*group, var).agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.countDistinct(state).alias("\0have"))
    return merged.join(members, group).where(F.col("\0have") == F.col("\0members")).drop("\0have", "\0members")


def meet_numeric(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Meet of two state tables: ``keys + (lo, hi, is_bottom)``."""
    a, b = left.select(*keys, F.struct("lo", "hi").alias("a")), right.select(*keys, F.struct("lo", "hi").alias("b"))
    both = a.join(b, keys, "full_outer")
    top = Itv.top()
    x = Itv(F.coalesce("a.lo", top.lo), F.coalesce("a.hi", top.hi))
    y = Itv(F.coalesce("b.lo", top.lo), F.coalesce("b.hi", top.hi))
    met = x.meet(y)
    return both.select(*keys, met.lo.alias("lo"), met.hi.alias("hi"), met.is_bottom().alias("is_bottom"))


def widen_numeric(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old widened by new; variables that either leaves open, or that open up, have no row."""
    a, b = old.select(*keys, F.struct("lo", "hi").alias("a")), new.select(*keys, F.struct("lo", "hi").alias("b"))
    w = Itv(F.col("a.lo"), F.col("a.hi")).widen(Itv(F.col("b.lo"), F.col("b.hi")))
    return a.join(b, keys).select(*keys, w.lo.alias("lo"), w.hi.alias("hi")).where(~w.is_top())


def implied_pairs(states: DataFrame, pairs: DataFrame, state: str, var: str = "var") -> DataFrame:
    """For each row of ``pairs(a, b)``, whether state a implies state b: every variable of b is at most as wide in a."""
    right = states.select(F.col(state).alias("b"), var, F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    left = states.select(F.col(state).alias("a"), var, "lo", "hi")
    checked = pairs.join(right, "b", "left").join(left, ["a", var], "left")
    holds = F.col("blo").isNull() | F.coalesce(Itv.of("lo", "hi").implies(Itv.of("blo", "bhi")), F.lit(False))
    return checked.groupBy("a", "b").agg(F.bool_and(holds).alias("implies"))


def join_masks(states: DataFrame, group: list[str], key: str, mask: str = "mask") -> DataFrame:
    """Outer join of nullness states."""
    return states.groupBy(*group, key).agg(F.bit_or(mask).alias(mask))


def implied_masks(states: DataFrame, pairs: DataFrame, state: str, key: str, mask: str = "mask") -> DataFrame:
    """For each row of ``pairs(a, b)``, whether nullness state a implies state b; a key that b does not have is bottom there."""
    left = states.select(F.col(state).alias("a"), key, F.col(mask).alias("\0x"))
    right = states.select(F.col(state).alias("b"), key, F.col(mask).alias("\0y"))
    checked = pairs.join(left, "a", "left").join(right, ["b", key], "left")
    holds = F.col("\0x").isNull() | (F.col("\0x").bitwiseAND(F.bitwise_not(F.coalesce("\0y", F.lit(0)))) == 0)
    return checked.groupBy("a", "b").agg(F.bool_and(holds).alias("implies"))


def united_addresses(states: DataFrame, group: list[str], address: str) -> DataFrame:
    """Union of address sets as rows, each address once: what is looked up next joins these rows, and no set is held in one place."""
    return states.select(*group, address).distinct()


def join_addresses(states: DataFrame, group: list[str], address: str) -> DataFrame:
    """Union of address sets, as sorted arrays; the distinct step before the list bounds what a group gathers."""
    return states.select(*group, address).distinct().groupBy(*group).agg(F.array_sort(F.collect_list(address)).alias("addresses"))


def weak_update(states: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Old joined with new at the written keys, others as they are."""
    return states.select(*keys, "lo", "hi").unionByName(written.select(*keys, "lo", "hi")).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def strong_update(states: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """New in place of old at the written keys."""
    return states.select(*keys, "lo", "hi").join(written.select(*keys), keys, "left_anti").unionByName(written.select(*keys, "lo", "hi"))


def havoc(states: DataFrame, reached: DataFrame, keys: list[str]) -> DataFrame:
    """Forget what an unknown callee may have changed: rows at reached keys go."""
    return states.join(reached.select(*keys).distinct(), keys, "left_anti")


def state_id(var: Column, lo: Column, hi: Column) -> Column:
    """An aggregate that identifies a state by its bounds, whatever the order of its rows; open variables do not count."""
    row = F.when(~((lo == float("-inf")) & (hi == float("inf"))), F.struct(var, lo, hi))
    return F.sha2(F.to_json(F.sort_array(F.collect_list(row))), 256)
