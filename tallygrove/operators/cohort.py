"""Cohorts: definition, membership, person counts, joins to other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import id_prefix


def define_cohort(table: DataFrame, condition: Column | str, key: str = "person_id") -> DataFrame:
    """Distinct keys of the rows that meet the condition."""
    return table.where(condition).select(key).distinct()


def in_cohort(table: DataFrame, cohort: DataFrame | None, key: str = "person_id") -> DataFrame:
    """Rows whose key is in the cohort; all rows when no cohort is given.

    A semi join needs no distinct cohort. Catalyst broadcasts a cohort it knows to be small, and
    adaptive execution splits a hot key on the table's side.
    """
    if cohort is None:
        return table
    return table.join(cohort.select(key), key, "left_semi")


def count_persons(
    table: DataFrame, cohort: DataFrame | None, name: str, key: str = "person_id", approximate: bool = False
) -> DataFrame:
    """One row with the number of distinct persons of a table that are in the cohort.

    Keys are made distinct before the join: each task sends every person once, so one person with
    a third of all rows weighs no more than any other.
    """
    keys = table.select(key).where(F.col(key).isNotNull())
    if approximate:
        return in_cohort(keys, cohort, key).agg(F.approx_count_distinct(key).alias(name))
    return in_cohort(keys.distinct(), cohort, key).agg(F.count(F.lit(1)).alias(name))


def join_on_keys(
    cohort: DataFrame, table: DataFrame, primary_key: str, visit_key: str | None = None, how: str = "inner"
) -> DataFrame:
    """Join on the primary key, and on the visit key too when both sides have it."""
    keys = [primary_key]
    if visit_key and visit_key in cohort.columns and visit_key in table.columns:
        keys.append(visit_key)
    return cohort.join(table, keys, how)


def join_on_prefix(
    table: DataFrame, composite: str, persons: DataFrame, person_key: str, sep: str = "-", count: int = 1
) -> DataFrame:
    """Equi-join by the key cut out of the front of a composite id."""
    keyed = table.withColumn("__prefix", id_prefix(F.col(composite), sep, count))
    return keyed.join(persons, keyed["__prefix"] == persons[person_key], "inner").drop("__prefix")
