"""Joins whose hot keys stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than its share of all rows, is joined in place.
HOT_ROWS = 1_000
#: Keys that are joined in place at most.
HOT_KEYS = 10_000


def join_split(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", rows: str = "n") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``rows`` the number of rows that ``left`` has of it.

    Keys above ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, so they may always be
    broadcast; rows of ``left`` with such a key are not shuffled. ``how`` is inner, left or left_anti.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = right.where(F.col(rows) > limit).drop(rows), right.where(F.coalesce(F.col(rows), F.lit(0)) <= limit).drop(rows)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return others if how == "left_anti" else others.unionByName(left.join(F.broadcast(hot), key))
