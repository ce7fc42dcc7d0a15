"""Measurements: summary by concept, unit and source; rows with person and source; most recent row per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    NO_MATCH, NULL_WORD, OUTLIER_LIMIT, PROGRAM_LABEL, PROGRAM_SOURCE, QUARTILES, RECORD_LABEL, UNIT_DEFAULT,
)
from ..session import stored, written
from .cohort import in_cohort
from .joins import join_null_safe
from .quantiles import group_quantiles


def source_label(src: Column, program: str = PROGRAM_SOURCE) -> Column:
    """Two-way source label; a missing source counts as a health record."""
    return F.when(src == program, PROGRAM_LABEL).otherwise(RECORD_LABEL)


def has_concept_value(concept: Column) -> Column:
    return F.coalesce(concept.isNotNull() & (concept != 0), F.lit(False))


def concepts_matching(concept: DataFrame, pattern: str) -> DataFrame:
    """Concepts whose name holds the pattern, in any case."""
    return concept.where(F.col("concept_name").rlike(f"(?i){pattern}"))


def concepts_in_use(measurement: DataFrame, concept: DataFrame, pattern: str) -> DataFrame:
    """Distinct measurement and unit concepts in the data whose measurement name matches."""
    pairs = measurement.select("measurement_concept_id", "unit_concept_id").distinct()
    names = concepts_matching(concept, pattern).select(
        F.col("concept_id").alias("measurement_concept_id"), F.col("concept_name").alias("measurement_name")
    )
    units = concept.select(F.col("concept_id").alias("unit_concept_id"), F.col("concept_name").alias("unit_name"))
    return pairs.join(names, "measurement_concept_id").join(units, "unit_concept_id", "left").distinct()


def measurement_summary(
    measurement: DataFrame,
    concept: DataFrame,
    ext: DataFrame,
    pattern: str,
    cohort: DataFrame | None = None,
    unit_concept: DataFrame | None = None,
    program_source: str = PROGRAM_SOURCE,
    method: str = "approx",
    interpolation: str = "linear",
    accuracy: int = 10000,
) -> DataFrame:
    """Figures by measurement concept, unit and source, for the concepts whose name matches.

    Ids are grouped first and names joined to the few result rows. Rows without a unit id fall out,
    so the default unit name only stands for a unit id that has no name.
    """
    wanted = concepts_matching(concept, pattern).select(
        F.col("concept_id").alias("measurement_concept_id"), F.col("concept_name").alias("measurement")
    ).distinct()
    units = (unit_concept if unit_concept is not None else concept).select(
        F.col("concept_id").alias("unit_concept_id"), F.col("concept_name").alias("unit_name")
    ).distinct()

    rows = measurement.where(F.col("unit_concept_id").isNotNull())
    # Written first, so that the planner knows how few ids there are: facts are not shuffled by concept then, an uneven key.
    ids = written(wanted.select("measurement_concept_id").distinct(), "concepts")
    rows = rows.join(ids, "measurement_concept_id", "left_semi")
    rows = in_cohort(rows, cohort)
    rows = rows.join(ext.select("measurement_id", "src_id"), "measurement_id", "left").withColumn(
        "measurement_source", source_label(F.col("src_id"), program_source)
    )

    keys = ["measurement_concept_id", "unit_concept_id", "measurement_source"]
    number, coded = F.col("value_as_number"), F.col("value_as_concept_id")
    figures = [
        F.count(F.lit(1)).alias("N"),
        F.count_if(number.isNull() & ~has_concept_value(coded)).alias("missing"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("avg"),
        F.stddev(number).alias("stddev"),
        F.count_if(number.isNotNull()).alias("num_numeric_values"),
        F.count_if(has_concept_value(coded)).alias("num_concept_values"),
        F.count_if(F.col("operator_concept_id").isNotNull()).alias("num_operators"),
    ]
    if method == "approx":
        quantiles = F.percentile_approx(number.cast("double"), list(QUARTILES), accuracy).alias("quantiles")
        summary = rows.groupBy(*keys).agg(*figures, quantiles)
    else:
        # Figures and quantiles read one narrow, stored frame; tables and joins are read once.
        rows = stored(rows.select(*keys, "value_as_number", "value_as_concept_id", "operator_concept_id"))
        summary = rows.groupBy(*keys).agg(*figures)
        quantiles = group_quantiles(rows, keys, "value_as_number", list(QUARTILES), interpolation, method)
        summary = join_null_safe(summary, quantiles.drop("n"), keys, "left")

    named = summary.join(wanted, "measurement_concept_id").join(units, "unit_concept_id", "left")
    return named.select(
        "measurement",
        F.coalesce("unit_name", F.lit(UNIT_DEFAULT)).alias("unit"),
        "N", "missing", "min", "max", "avg", "stddev", "quantiles",
        "num_numeric_values", "num_concept_values", "num_operators",
        "measurement_source", "measurement_concept_id", "unit_concept_id",
    ).orderBy(F.desc("N"), "measurement_concept_id", "unit_concept_id", "measurement_source", "measurement")


def persons_with_sex(person: DataFrame, concept: DataFrame) -> DataFrame:
    """Persons with the name of their sex. Names of the few ids in use are written first, so that persons are not shuffled by them."""
    used = person.select(F.col("sex_at_birth_concept_id").alias("concept_id")).distinct()
    named = concept.select("concept_id", "concept_name").join(used, "concept_id", "left_semi")
    sexes = written(named.select(F.col("concept_id").alias("sex_at_birth_concept_id"), F.col("concept_name").alias("sex_at_birth")), "sexes")
    return person.join(sexes, "sex_at_birth_concept_id", "left").select("person_id", "birth_datetime", "sex_at_birth")


def _of_interest(
    measurement: DataFrame, measurement_concept_id, unit_concept_id, cohort: DataFrame | None
) -> DataFrame:
    kept = measurement.where(
        (F.col("measurement_concept_id") == F.lit(measurement_concept_id))
        & (F.col("unit_concept_id") == F.lit(unit_concept_id))
    )
    return in_cohort(kept, cohort)


def _with_person(rows: DataFrame, person: DataFrame, concept: DataFrame, ext: DataFrame) -> DataFrame:
    """Person's columns first, then source and measurement columns; the person id is the person table's own."""
    persons = persons_with_sex(person, concept)
    joined = (
        rows.withColumnRenamed("person_id", "__person")
        .join(persons, F.col("__person") == F.col("person_id"), "left")
        .join(ext.select("measurement_id", "src_id"), "measurement_id", "left")
    )
    rest = [c for c in rows.columns if c not in ("person_id", "measurement_id")]
    return joined.select("person_id", "birth_datetime", "sex_at_birth", "src_id", *rest, "measurement_id")


def _ordered(rows: DataFrame, ordered: bool) -> DataFrame:
    return (rows.orderBy("person_id", "measurement_id") if ordered else rows).drop("measurement_id")


def measurement_rows(
    measurement: DataFrame, person: DataFrame, concept: DataFrame, ext: DataFrame,
    measurement_concept_id, unit_concept_id, cohort: DataFrame | None = None, ordered: bool = True,
) -> DataFrame:
    """All rows of one measurement and unit, with birth date, sex and source."""
    rows = _of_interest(measurement, measurement_concept_id, unit_concept_id, cohort)
    return _ordered(_with_person(rows, person, concept, ext), ordered)


def latest_per_person(measurement: DataFrame, key: str | list[str] = "person_id") -> DataFrame:
    """Latest row per person: by date, time and id.

    The rank filter is pushed below the shuffle as a group limit, so every task sends one row per
    person and a hot person does not gather in one place.
    """
    recency = Window.partitionBy(key).orderBy(
        F.desc("measurement_date"), F.desc("measurement_datetime"), F.desc("measurement_id")
    )
    return measurement.withColumn("recency_rank", F.row_number().over(recency)).where("recency_rank = 1").drop("recency_rank")


def most_recent(
    measurement: DataFrame, person: DataFrame, concept: DataFrame, ext: DataFrame,
    measurement_concept_id, unit_concept_id, cohort: DataFrame | None = None, ordered: bool = True,
) -> DataFrame:
    """The most recent row per person of one measurement and unit.

    Rows are ranked before the cohort is applied: a cohort takes persons whole, so the result is the
    same, and the join meets one row per person instead of all rows of a hot one.
    """
    rows = _of_interest(measurement, measurement_concept_id, unit_concept_id, None)
    latest = in_cohort(latest_per_person(rows), cohort)
    return _ordered(_with_person(latest, person, concept, ext), ordered)


def first_concept(df: DataFrame, name: str, order: str) -> DataFrame:
    """One row with the concept name of the earliest row."""
    return df.where(F.col(name).isNotNull()).agg(F.min_by(name, order).alias(name))


def plot_rows(
    df: DataFrame,
    concept_name: str | DataFrame,
    name: str = "standard_concept_name",
    unit: str = "unit_concept_name",
    sex: str | None = "sex_at_birth",
    value: str = "value_as_number",
    null_policy: str = "drop_unit",
    age: str | None = None,
) -> DataFrame:
    """Rows fit for plotting: one concept, matched units and sexes, no outliers, and a known age if one is named.

    ``drop_unit`` drops missing units and keeps missing sexes; ``drop_sex`` does the reverse and also
    drops the word NULL among the units. Missing and outlying values always go.
    """
    wanted = concept_name.scalar() if isinstance(concept_name, DataFrame) else F.lit(concept_name)
    rows = df.where(F.col(name) == wanted)
    if null_policy == "drop_unit":
        rows = rows.where(F.col(unit).isNotNull() & (F.col(unit) != NO_MATCH))
        if sex:
            rows = rows.where(F.coalesce(F.col(sex) != NO_MATCH, F.lit(True)))
    elif null_policy == "drop_sex":
        rows = rows.where(F.coalesce(~F.col(unit).isin(NO_MATCH, NULL_WORD), F.lit(True)))
        if sex:
            rows = rows.where(F.col(sex) != NO_MATCH)
    else:
        raise ValueError("null_policy is 'drop_unit' or 'drop_sex'")
    if age:
        rows = rows.where(F.col(age).isNotNull())
    return within_limit(rows, value)


def within_limit(df: DataFrame, value: str = "value_as_number") -> DataFrame:
    """Drop missing values and values at or above the outlier limit."""
    return df.where(F.col(value) < OUTLIER_LIMIT)
