"""Context keys of calls: what tells the contexts of a callee apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_string(site: Column, caller: Column, k: int) -> Column:
    """The k newest call sites, the newest first: an array of at most k; k = 0 has one context for all calls."""
    if k == 0:
        return F.array().cast("array<string>")
    return F.slice(F.concat(F.array(site), F.coalesce(caller, F.array().cast("array<string>"))), 1, k)
