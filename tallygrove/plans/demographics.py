"""Ages, bands, box-plot figures, surveys, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ages as a
from ..operators import boxplot as b
from ..operators import measurement as m
from ..operators import profile as p
from ..operators import survey as s
from . import query
from .bind import (
    EVENT_SQL, PERSON_SQL, SURVEY_SQL, event_measurements, event_sources, persons, rounded, sexes, survey, table,
)

_JOINED_SQL = f"""WITH {PERSON_SQL}, {EVENT_SQL}, joined AS (
  SELECT *, CAST(floor((measurement_date - birth_datetime) / 365.24) AS BIGINT) AS age,
         date_sub('year', birth_datetime, measurement_date) AS calendar_age
  FROM meas JOIN person USING (person_id)),
rows_ AS (
  SELECT *, CASE WHEN age <= 34.5 THEN '<35' WHEN age <= 49.5 THEN '35-49' WHEN age <= 64.5 THEN '50-64' ELSE '65+' END AS age_group
  FROM joined)"""


def _joined(spark, sf_dir, sex=False, site=False):
    """Measurements with person and ages, and with sex and source where they are asked for."""
    people = persons(spark, sf_dir)
    if sex:
        people = m.persons_with_sex(people, sexes(spark, sf_dir))
    rows = event_measurements(spark, sf_dir).join(people, "person_id")
    if site:
        rows = rows.join(event_sources(spark, sf_dir), "measurement_id", "left")
    age = a.age_by_days(F.col("measurement_date"), F.col("birth_datetime"))
    return rows.withColumn("age", age).withColumn("age_group", a.age_band(F.col("age")))


@query("age_days", f"{_JOINED_SQL} SELECT measurement_id, age FROM rows_")
def age_days(spark, sf_dir):
    return _joined(spark, sf_dir).select("measurement_id", "age")


@query(
    "age_days_timed",
    f"""WITH {PERSON_SQL}, {EVENT_SQL}
        SELECT measurement_id, CAST(floor(floor(date_diff('microsecond', CAST(birth_datetime AS TIMESTAMP) + INTERVAL 13 HOUR,
               measurement_datetime) / 86400000000.0) / 365.24) AS BIGINT) AS age
        FROM meas JOIN person USING (person_id)""",
)
def age_days_timed(spark, sf_dir):
    """Births at one o'clock in the afternoon: only whole 24-hour spans count."""
    born = F.col("birth_datetime").cast("timestamp") + F.expr("INTERVAL 13 HOURS")
    return _joined(spark, sf_dir).select("measurement_id", a.age_by_days(F.col("measurement_datetime"), born).alias("age"))


@query("age_calendar", f"{_JOINED_SQL} SELECT measurement_id, CAST(calendar_age AS BIGINT) AS age FROM joined")
def age_calendar(spark, sf_dir):
    years = a.age_by_calendar(F.col("measurement_date"), F.col("birth_datetime"))
    return _joined(spark, sf_dir).select("measurement_id", years.alias("age"))


@query("age_today", f"WITH {PERSON_SQL} SELECT person_id, 2024 - year(birth_datetime) AS age FROM person")
def age_today(spark, sf_dir):
    as_of = F.lit("2024-06-30").cast("date")
    return persons(spark, sf_dir).select("person_id", a.age_today(F.col("birth_datetime"), as_of).alias("age"))


@query("age_band", f"{_JOINED_SQL} SELECT age_group, count(*) AS n FROM rows_ GROUP BY age_group")
def age_band(spark, sf_dir):
    return _joined(spark, sf_dir).groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))


def _width_sql(width: int) -> str:
    """The cut by its definition: edges are multiples of the width from below the least age on; a band holds its upper edge, the first both."""
    return f"""{_JOINED_SQL}, bounds AS (SELECT CAST(floor(min(calendar_age) / {width}.0) AS BIGINT) * {width} AS low, max(calendar_age) AS high FROM joined),
      edges AS (SELECT unnest(generate_series(low, greatest(high, low + 1) + {width} - 1, {width})) AS edge, low FROM bounds),
      bands AS (SELECT edge - {width} AS a, edge AS b, edge - {width} = low AS lowest FROM edges WHERE edge > low)
      SELECT CASE WHEN lowest THEN '[' ELSE '(' END || CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) || ']' AS age_group, count(*) AS n
      FROM joined JOIN bands ON calendar_age <= b AND (calendar_age > a OR lowest AND calendar_age = a) GROUP BY ALL"""


def _width(spark, sf_dir, width):
    years = a.age_by_calendar(F.col("measurement_date"), F.col("birth_datetime"))
    aged = _joined(spark, sf_dir).select(years.alias("years"))
    least = aged.agg(F.min("years")).first()[0]
    banded = aged.select(a.width_band(F.col("years"), width, least).alias("age_group"))
    return banded.groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))


@query("age_width_10", _width_sql(10))
def age_width_10(spark, sf_dir):
    return _width(spark, sf_dir, 10)


@query("age_width_5", _width_sql(5))
def age_width_5(spark, sf_dir):
    return _width(spark, sf_dir, 5)


def _box_sql(keys: str, where: str = "value_as_number < 9999999") -> str:
    on = " AND ".join(f"r.{k.strip()} IS NOT DISTINCT FROM q.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f"""{_JOINED_SQL}, plotted AS (SELECT * FROM rows_ WHERE {where}),
q AS (SELECT {keys}, quantile_cont(value_as_number, 0.25) AS q1, quantile_cont(value_as_number, 0.5) AS median,
             quantile_cont(value_as_number, 0.75) AS q3 FROM plotted GROUP BY {keys})
SELECT {picked}, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       min(value_as_number) FILTER (value_as_number BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
       max(value_as_number) FILTER (value_as_number BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
       count(*) FILTER (value_as_number NOT BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS outliers,
       max(value_as_number) AS y, 'N = ' || CAST(count(*) AS VARCHAR) AS label
FROM plotted AS r JOIN q ON {on} GROUP BY {picked}"""


def _box(rows, keys):
    return rounded(b.box_figures(m.within_limit(rows), keys, method="exact"), "q1", "median", "q3")


@query("box_by_sex", _box_sql("sex_at_birth"))
def box_by_sex(spark, sf_dir):
    return _box(_joined(spark, sf_dir, sex=True), ["sex_at_birth"])


@query("box_by_site", _box_sql("src_id"))
def box_by_site(spark, sf_dir):
    return _box(_joined(spark, sf_dir, site=True), ["src_id"])


@query("box_by_age_sex", _box_sql("age_group, sex_at_birth"))
def box_by_age_sex(spark, sf_dir):
    return _box(_joined(spark, sf_dir, sex=True).where(F.col("age_group").isNotNull()), ["age_group", "sex_at_birth"])


_NAMED_SQL = """CASE WHEN unit_concept_id = 0 THEN 'No matching concept' WHEN unit_concept_id = 1 THEN NULL ELSE 'mg' END"""
_SEX_SQL = """CASE WHEN sex_at_birth = 'NATION_1' THEN 'No matching concept' WHEN sex_at_birth = 'NATION_2' THEN NULL ELSE sex_at_birth END"""


def _named(spark, sf_dir):
    """Frame with names, where some units and sexes are unmatched or missing."""
    unit = F.when(F.col("unit_concept_id") == 0, "No matching concept").when(F.col("unit_concept_id") == 2, "mg")
    sex = F.when(F.col("sex_at_birth") == "NATION_1", "No matching concept").when(
        F.col("sex_at_birth") != "NATION_2", F.col("sex_at_birth")
    )
    return (
        _joined(spark, sf_dir, sex=True)
        .withColumnRenamed("measurement_concept_id", "standard_concept_name")
        .withColumn("unit_concept_name", unit)
        .withColumn("sex_at_birth", sex)
    )


def _plot_sql(where: str, keys: str) -> str:
    return f"""{_JOINED_SQL}, named AS (SELECT measurement_id, person_id, value_as_number, age, age_group, calendar_age,
        measurement_concept_id AS standard_concept_name, {_NAMED_SQL} AS unit_concept_name, {_SEX_SQL} AS sex_at_birth FROM rows_)
        SELECT {keys}, count(*) AS n, max(value_as_number) AS y FROM named
        WHERE standard_concept_name = (SELECT event_type FROM events ORDER BY event_id LIMIT 1)
          AND value_as_number < 9999999 AND {where} GROUP BY {keys}"""


def _plotted(spark, sf_dir, keys, policy):
    rows = _named(spark, sf_dir)
    events = event_measurements(spark, sf_dir).withColumnRenamed("measurement_concept_id", "standard_concept_name")
    first = m.first_concept(events, "standard_concept_name", "measurement_id")
    kept = m.plot_rows(rows, first, null_policy=policy, age="age")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("value_as_number").alias("y"))


@query(
    "plot_rows_drop_unit",
    _plot_sql(
        "unit_concept_name <> 'No matching concept' AND coalesce(sex_at_birth, '') <> 'No matching concept'",
        "standard_concept_name, unit_concept_name, sex_at_birth, age_group",
    ),
)
def plot_rows_drop_unit(spark, sf_dir):
    keys = ["standard_concept_name", "unit_concept_name", "sex_at_birth", "age_group"]
    return _plotted(spark, sf_dir, keys, "drop_unit")


@query(
    "plot_rows_drop_sex",
    _plot_sql(
        "coalesce(unit_concept_name, '') NOT IN ('No matching concept', 'NULL') AND sex_at_birth <> 'No matching concept'",
        "standard_concept_name, unit_concept_name, sex_at_birth",
    ),
)
def plot_rows_drop_sex(spark, sf_dir):
    return _plotted(spark, sf_dir, ["standard_concept_name", "unit_concept_name", "sex_at_birth"], "drop_sex")


@query(
    "box_by_unit_sex",
    _box_sql("measurement_concept_id, unit_concept_id, sex_at_birth"),
)
def box_by_unit_sex(spark, sf_dir):
    return _box(_joined(spark, sf_dir, sex=True), ["measurement_concept_id", "unit_concept_id", "sex_at_birth"])


@query(
    "box_by_unit_age_sex",
    _box_sql("measurement_concept_id, unit_concept_id, age_group, sex_at_birth"),
)
def box_by_unit_age_sex(spark, sf_dir):
    return _box(_joined(spark, sf_dir, sex=True), ["measurement_concept_id", "unit_concept_id", "age_group", "sex_at_birth"])


@query(
    "group_labels",
    f"{_JOINED_SQL} SELECT sex_at_birth, max(value_as_number) AS y, 'N = ' || CAST(count(*) AS VARCHAR) AS label FROM rows_ GROUP BY sex_at_birth",
)
def group_labels(spark, sf_dir):
    return b.group_label(_joined(spark, sf_dir, sex=True), ["sex_at_birth"])


@query(
    "survey_question",
    f"""WITH {SURVEY_SQL} SELECT answer_concept_id, answer, count(DISTINCT person_id) AS n_participant,
        round(100.0 * count(DISTINCT person_id) / 150, 2) AS response_rate
        FROM survey WHERE question_concept_id = 2 GROUP BY answer_concept_id, answer""",
)
def survey_question(spark, sf_dir):
    return s.question_counts(survey(spark, sf_dir), 2, 150)


@query(
    "survey_question_known",
    f"""WITH {SURVEY_SQL} SELECT 'asked' AS which, count(*) > 0 AS known, min(question) AS question FROM survey WHERE question_concept_id = 2
        UNION ALL SELECT 'unasked', count(*) > 0, min(question) FROM survey WHERE question_concept_id = 77""",
)
def survey_question_known(spark, sf_dir):
    asked = s.question_known(survey(spark, sf_dir), 2).withColumn("which", F.lit("asked"))
    return asked.unionByName(s.question_known(survey(spark, sf_dir), 77).withColumn("which", F.lit("unasked")))


@query(
    "survey_module",
    f"""WITH {SURVEY_SQL} SELECT survey, question_concept_id, question, count(DISTINCT person_id) AS n_participant,
        round(100.0 * count(DISTINCT person_id) / 150, 2) AS response_rate
        FROM survey WHERE lower(survey) = 'click' GROUP BY survey, question_concept_id, question""",
)
def survey_module(spark, sf_dir):
    return s.module_counts(survey(spark, sf_dir), "Click", 150)


@query(
    "survey_all_modules",
    f"""WITH {SURVEY_SQL} SELECT survey, question_concept_id, question, count(DISTINCT person_id) AS n_participant
        FROM survey GROUP BY survey, question_concept_id, question""",
)
def survey_all_modules(spark, sf_dir):
    return s.module_counts(survey(spark, sf_dir))


_PROFILED = {
    "o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False,
    "o_orderpriority": False,
}


def _profile_sql(source: str) -> str:
    def one(name: str, number: bool) -> str:
        def numeric(text: str) -> str:
            return text if number else "CAST(NULL AS DOUBLE)"

        return f"""SELECT '{name}' AS "column", count({name}) AS n, count(*) - count({name}) AS missing,
            count(DISTINCT {name}) AS n_distinct, {numeric(f'round(avg({name}), 4)')} AS mean,
            {numeric(f'round(stddev_samp({name}), 4)')} AS stddev, {numeric(f'CAST(min({name}) AS DOUBLE)')} AS min,
            {numeric(f'round(quantile_cont({name}, 0.25), 6)')} AS q1, {numeric(f'round(quantile_cont({name}, 0.5), 6)')} AS median,
            {numeric(f'round(quantile_cont({name}, 0.75), 6)')} AS q3, {numeric(f'CAST(max({name}) AS DOUBLE)')} AS max FROM src"""

    parts = " UNION ALL ".join(one(n, k) for n, k in _PROFILED.items())
    return f"WITH src AS ({source}) {parts}"


def _rounded_profile(df):
    return rounded(rounded(df, "mean", "stddev", digits=4), "q1", "median", "q3")


@query("profile", _profile_sql("SELECT * FROM orders"))
def profile(spark, sf_dir):
    return _rounded_profile(p.column_profile(table(spark, sf_dir, "orders"), method="exact"))


@query("profile_first_rows", _profile_sql("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10001"))
def profile_first_rows(spark, sf_dir):
    """The short form of the profile, which looks at the first 10,001 rows by its definition."""
    return _rounded_profile(p.column_profile(table(spark, sf_dir, "orders"), method="exact", rows=p.PROFILE_ROWS, order=["o_orderkey"]))


@query(
    "profile_sketch",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, true AS distinct_close, true AS quartiles_close FROM lineitem"""
        for c in (
            "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
        ).split()
    ),
)
def profile_sketch(spark, sf_dir):
    """The one-pass profile of a large table: exact counts, and whether its estimates lie within their stated errors of the exact profile."""
    lines = table(spark, sf_dir, "lineitem")
    rough, exact = p.column_profile(lines), p.column_profile(lines, method="exact")
    # One hundredth of the range around each quartile is far wider than the sketch's rank error allows for these values.
    met = rough.alias("r").join(exact.alias("e"), "column")
    near = F.lit(True)
    for q in ("q1", "median", "q3"):
        near = near & (F.abs(F.col(f"r.{q}") - F.col(f"e.{q}")) <= (F.col("e.max") - F.col("e.min")) / 100 + F.lit(1))
    distinct = F.abs(F.col("r.n_distinct") - F.col("e.n_distinct")) <= F.col("e.n_distinct") * 0.2 + 1
    return met.select(
        "column", "r.n", "r.missing", distinct.alias("distinct_close"),
        F.when(F.col("e.mean").isNull(), True).otherwise(near).alias("quartiles_close"),
    )


@query(
    "profile_nested",
    """SELECT 'vec_id' AS "column", count(vec_id) AS n, count(*) - count(vec_id) AS missing, max(vec_id)::DOUBLE AS max FROM embeddings
       UNION ALL SELECT 'embedding', count(embedding), count(*) - count(embedding), NULL FROM embeddings
       UNION ALL SELECT 'label', count(label), count(*) - count(label), max(label)::DOUBLE FROM embeddings""",
)
def profile_nested(spark, sf_dir):
    """A table with a list column, which has counts only."""
    return p.column_profile(table(spark, sf_dir, "embeddings")).select("column", "n", "missing", "max")


@query(
    "frame_shape",
    "SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns FROM labels JOIN documents USING (doc_id)",
)
def frame_shape(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return p.frame_shape(joined)
