"""Nullness as two-bit masks: 0 bottom, 1 null, 2 not null, 3 unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOTTOM, NULL, NOT_NULL, TOP = 0, 1, 2, 3


def of(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(NULL)).otherwise(F.lit(NOT_NULL))


def join(a: Column, b: Column) -> Column:
    """Also the widening: the lattice is finite."""
    return a.bitwiseOR(b)


def join_all(mask: Column) -> Column:
    return F.bit_or(mask)


def implies(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b)) == 0


def assume_null(mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(NULL))


def assume_not_null(mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(NOT_NULL))


def feasible(mask: Column) -> Column:
    """Whether a value may be truthy: null and bottom may not."""
    return mask.bitwiseAND(F.lit(NOT_NULL)) != 0


def name(mask: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("bottom", "null", "not null", "unknown"))), mask + 1)
