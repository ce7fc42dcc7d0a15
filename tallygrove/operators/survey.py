"""Survey response counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def response_rate(count: Column, denominator: float | None, as_text: bool = False) -> Column | None:
    """Percentage with two decimals; none without a denominator or with 0."""
    if not denominator:
        return None
    rate = F.round(count * F.lit(100) / F.lit(denominator), 2)
    return F.concat(rate.cast("string"), F.lit("%")) if as_text else rate


def _count(df: DataFrame, keys: list[str], keep_missing: bool, denominator, as_text: bool) -> DataFrame:
    if keep_missing:
        # A missing person counts once and groups with missing keys stay.
        persons = F.count_distinct("person_id") + F.max(F.col("person_id").isNull().cast("long"))
    else:
        df = df.dropna(subset=keys)
        persons = F.count_distinct("person_id")
    counted = df.groupBy(*keys).agg(persons.alias("n_participant"))
    rate = response_rate(F.col("n_participant"), denominator, as_text)
    return counted if rate is None else counted.withColumn("response_rate", rate)


def question_counts(
    survey: DataFrame, question_concept_id: int, denominator: float | None = None,
    keep_missing: bool = False, as_text: bool = False,
) -> DataFrame:
    """Distinct persons by answer of one question; an unknown question gives no rows."""
    rows = survey.where(F.col("question_concept_id") == question_concept_id)
    counted = _count(rows, ["answer_concept_id", "answer"], keep_missing, denominator, as_text)
    return counted.withColumn("answer_concept_id", F.col("answer_concept_id").cast("int"))


def question_known(survey: DataFrame, question_concept_id: int) -> DataFrame:
    """One row: whether any row has the question, and its text."""
    hit = F.col("question_concept_id") == question_concept_id
    return survey.agg(
        (F.count_if(hit) > 0).alias("known"), F.min(F.when(hit, F.col("question"))).alias("question")
    )


def module_counts(
    survey: DataFrame, module: str | None = None, denominator: float | None = None,
    keep_missing: bool = False, as_text: bool = False,
) -> DataFrame:
    """Distinct persons by question of one survey, named in any case, or of all surveys."""
    rows = survey.where(F.lower("survey") == module.lower()) if module else survey
    return _count(rows, ["survey", "question_concept_id", "question"], keep_missing, denominator, as_text)
