"""Counts with totals, top values, limits and the small-cell rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LIMITS, SMALL_CELL
from ..session import written


def count_with_total(df: DataFrame, keys: list[str], person: str | None = None) -> DataFrame:
    """Counts by group next to the grand total, which has missing keys and ``is_total`` set."""
    measure = F.count_distinct(person) if person else F.count(F.lit(1))
    grouped = df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(measure.alias("n"), F.grouping_id().alias("__level"))
    return grouped.withColumn("is_total", F.col("__level") > 0).drop("__level")


def top_values(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most common values; ties go by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def top_scores(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k rows with the highest score; ties go by the named column."""
    return df.where(F.col(score).isNotNull()).orderBy(F.desc(score), tie).limit(k)


def limit_for(df: DataFrame, mode: str = "explore") -> DataFrame:
    """Row limit by purpose: a look, input of an aggregation, or everything."""
    rows = LIMITS[mode]
    return df if rows is None else df.limit(rows)


def hide_small_cells(
    df: DataFrame, keys: list[str], figures: dict[str, Column], person: str = "person_id", limit: int = SMALL_CELL,
    also: list[list[str]] | None = None, complement: bool = True,
) -> DataFrame:
    """Figures by group; a group of fewer persons than the limit shows none and is flagged.

    ``also`` names further sets of keys to group by in the same pass: totals. Keys a row is not grouped by are
    missing in it, and ``grouped_by`` lists those it is grouped by. With totals, ``complement`` also hides, and flags,
    groups that would let a hidden one be found by subtraction (see ``hide_complements``); the totals must be nested then.
    """
    sets = [keys, *(also or [])]
    grouped = df.groupingSets([[F.col(k) for k in names] for names in sets], *keys).agg(
        F.count_distinct(person).alias("__persons"), *[f.alias(name) for name, f in figures.items()],
        F.array_compact(F.array(*[F.when(F.grouping(k) == 0, k) for k in keys])).alias("grouped_by"),
    ).withColumn("suppressed", F.col("__persons") < limit)
    if also and complement:
        grouped = hide_complements(grouped, sets, limit)
    shown = ~F.col("suppressed")
    return grouped.select(
        *keys, *(["grouped_by"] if also else []), F.when(shown, F.col("__persons")).alias("n_persons"),
        *[F.when(shown, F.col(name)).alias(name) for name in figures], "suppressed",
    )


def hide_complements(
    cells: DataFrame, sets: list[list[str]], limit: int = SMALL_CELL, persons: str = "__persons", grouped_by: str = "grouped_by", hidden: str = "suppressed",
) -> DataFrame:
    """Groups and their totals with more of them hidden, so that no hidden figure follows from the shown ones.

    A shown total less its shown parts gives what its hidden parts have together. So there must be two hidden parts or more, with
    as many persons together as the limit asks for: where not, the smallest shown part is hidden too, or the total if none is
    left. A hidden total, in turn, must have a hidden part, or its parts would add up to it. Hidden totals count as hidden
    parts of the next total. Going once from the finest groups to the last total, which may hide totals, and once back, which
    hides parts of totals, settles all: the way back changes no total and leaves each with a hidden part.

    ``sets`` are nested sets of keys, so that every group is part of one next total. Each step is a sum over parts and two joins on the
    keys of the total; only the smallest shown part of each is looked for, so that no total's parts are gathered. A tie goes by key.
    """
    chain = sorted(sets, key=len, reverse=True)
    if any(not set(small) < set(large) for large, small in zip(chain, chain[1:], strict=False)):
        raise ValueError("totals that hide complements must be nested sets of keys")
    cells = written(cells.select(*(c for c in cells.columns if c != hidden), hidden), "cells")  # a table, so that the planner knows its size
    levels = [cells.where(F.size(grouped_by) == len(names)) for names in chain]

    def met(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
        named = found.withColumnsRenamed({k: f"__of_{k}" for k in names})
        same = F.lit(0) == F.col("__all")
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
        return rows.join(named, same, "left").drop("__all", *(f"__of_{k}" for k in names))

    def sums(parts: DataFrame, names: list[str], own: list[str]) -> DataFrame:
        gone = F.col(hidden)
        return parts.withColumn("__all", F.lit(0)).groupBy("__all", *names).agg(
            F.count_if(gone).alias("__n"), F.sum(F.when(gone, F.col(persons))).alias("__together"),
            F.min(F.when(~gone, F.struct(persons, *own))).alias("__next"))

    def hide_part(parts: DataFrame, totals: DataFrame, names: list[str], own: list[str]) -> DataFrame:
        chosen = totals.where("__chosen IS NOT NULL").select(F.lit(0).alias("__all"), *names, "__chosen")
        more = met(parts, chosen, names)
        this = F.struct(persons, *own).eqNullSafe(F.col("__chosen")) & F.col("__chosen").isNotNull()
        return more.withColumn(hidden, F.col(hidden) | this).drop("__chosen")

    for i in range(1, len(chain)):
        names, own = chain[i], [k for k in chain[i - 1] if k not in chain[i]]
        totals = met(levels[i], sums(levels[i - 1], names, own), names)
        found = ~F.col(hidden) & (F.col("__n") >= 1) & ((F.col("__n") < 2) | (F.col("__together") < limit))
        totals = totals.select(
            *cells.columns[:-1], (F.col(hidden) | (found & F.col("__next").isNull())).alias(hidden), F.when(found, F.col("__next")).alias("__chosen"))
        totals = written(totals, "totals")
        levels[i - 1] = hide_part(levels[i - 1], totals, names, own)
        levels[i] = totals.drop("__chosen")
    for i in range(len(chain) - 1, 0, -1):
        names, own = chain[i], [k for k in chain[i - 1] if k not in chain[i]]
        totals = met(levels[i], sums(levels[i - 1], names, own), names)
        chosen = totals.where(F.col(hidden) & (F.col("__n") == 0)).select(*names, F.col("__next").alias("__chosen"))
        levels[i - 1] = hide_part(levels[i - 1], written(chosen, "chosen"), names, own)
    return reduce(DataFrame.unionByName, levels)
