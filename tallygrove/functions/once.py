"""Columns computed once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add costly columns behind a generator, each seeing the ones before it.

    Projections and filters merge and would repeat parsing or array work for every later use; a
    generator is not merged, so each value is computed a single time.
    """
    for name, value in values.items():
        df = df.select("*", F.explode_outer(F.array(value)).alias(name))
    return df


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """A value computed once within an expression, however often ``use`` names it; cheaper than a column of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
