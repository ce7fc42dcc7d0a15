"""Person counts from stored sets: Theta sketches that are united and intersected without reading facts again.

A set keeps the ``2 ** lg`` smallest hashes of its persons, whatever their number, and is exact up to about as many.
Sets are built once, by every task before the shuffle, so neither a hot person nor a hot group gathers rows. Persons
that are null are in no set. Groups without rows have no set; the set of an empty table is empty and counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** LG hashes are kept per set, 8 bytes each.
LG = 12
#: Standard deviations in a stated error.
DEVIATIONS = 5


def person_sets(table: DataFrame, keys: list[str], person: str = "person_id", lg: int = LG) -> DataFrame:
    """``keys`` and ``persons``, the set of distinct persons, one row per group; one row in all without keys."""
    return table.where(F.col(person).isNotNull()).groupBy(*keys).agg(F.theta_sketch_agg(person, lg).alias("persons"))


def merged_sets(sets: DataFrame, keys: list[str], lg: int = LG) -> DataFrame:
    """Stored sets united up to fewer keys: a person of several groups counts once."""
    return sets.groupBy(*keys).agg(F.theta_union_agg("persons", lg).alias("persons"))


def _size(persons: Column | str) -> Column:
    return F.theta_sketch_estimate(persons).cast("long")


def _error(found: Column, largest: Column, lg: int) -> Column:
    """Persons that a count may be off: of sets of ``largest``, every person is kept with a chance of one in ``rate + 1``."""
    rate = F.greatest(largest / float(1 << lg) - 1, F.lit(0.0))
    return F.ceil(DEVIATIONS * (F.sqrt(F.greatest(found.cast("double"), rate) * rate) + rate)).cast("long")


def count_within(sets: DataFrame, cohort: DataFrame, lg: int = LG) -> DataFrame:
    """Per row of ``sets`` the number of persons and of those in the cohort, with the error of each.

    ``cohort`` is a set of one row (``person_sets`` of the cohort without keys). Adds ``n_persons``, ``persons_error``, ``n_within`` and
    ``within_error``; an error of 0 marks an exact count.
    """
    whole = cohort.select("persons").scalar()
    both = F.theta_intersection("persons", whole)
    sized = sets.select("*", _size("persons").alias("n_persons"), _size(both).alias("n_within"), _size(whole).alias("__cohort"))
    n, within = F.col("n_persons"), F.col("n_within")
    return sized.select(
        "*", _error(n, n, lg).alias("persons_error"), _error(within, F.greatest("n_persons", "__cohort"), lg).alias("within_error")
    ).drop("__cohort", "persons")
