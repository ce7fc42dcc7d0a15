"""Null-safe equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which missing keys match each other; the left side's key columns are kept.

    ``eqNullSafe`` stays an equi-join for Catalyst, so it is hashed or merged and
    adaptive execution may split a hot key on the left.
    """
    marked = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"__r_{k}"]) for k in keys])
    joined = left.join(marked, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def join_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column both frames have; missing keys match each other."""
    keys = [c for c in left.columns if c in set(right.columns)]
    if not keys:
        raise ValueError("the two frames have no column in common")
    return join_null_safe(left, right, keys)
