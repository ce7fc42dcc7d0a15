"""Adapters: the given tables in the roles the operators expect, with the same adapters in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Its schema is read from the file footer once, not on every use."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def tasks_of(df: DataFrame, rows: int) -> int:
    """Number of tasks of about so many rows each."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Narrow rows that grow wide in later steps, dealt out by key to tasks of about so many rows: a small file is few tasks."""
    return df.repartition(tasks_of(df, rows), *keys)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates and times as text, for comparison across engines."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in names else F.col(c) for c in df.columns])


def quartile_columns(df: DataFrame) -> DataFrame:
    names = ("q_min", "q1", "q_median", "q3", "q_max")
    return df.select("*", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)]).drop("quantiles")


# ---- persons: customers ----

def birth_date(key: Column) -> Column:
    return F.date_add(F.lit("1930-01-01").cast("date"), (key * 7919 % 25000).cast("int"))


BIRTH_SQL = "(DATE '1930-01-01' + CAST(c_custkey * 7919 % 25000 AS INTEGER))"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"),
        birth_date(F.col("c_custkey")).alias("birth_datetime"),
        F.col("c_nationkey").alias("sex_at_birth_concept_id"),
    )


def sexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("concept_id"), F.col("n_name").alias("concept_name")
    )


PERSON_SQL = f"""person AS (
  SELECT c_custkey AS person_id, {BIRTH_SQL} AS birth_datetime, n_name AS sex_at_birth
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"""


# ---- measurements: events ----

def event_number() -> Column:
    """The number inside an event's properties."""
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER)"


def event_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("measurement_id"),
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("measurement_concept_id"),
        (event_number() % 3).alias("unit_concept_id"),
        F.to_date("ts").alias("measurement_date"),
        F.col("ts").alias("measurement_datetime"),
        F.col("value").alias("value_as_number"),
    )


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("measurement_id"), F.concat(F.lit("site"), F.col("user_id") % 5).alias("src_id")
    )


EVENT_SQL = f"""meas AS (
  SELECT event_id AS measurement_id, user_id AS person_id, event_type AS measurement_concept_id,
         {K_SQL} % 3 AS unit_concept_id, CAST(ts AS DATE) AS measurement_date, ts AS measurement_datetime,
         value AS value_as_number, 'site' || CAST(user_id % 5 AS VARCHAR) AS src_id
  FROM events)"""


# ---- measurements: order lines ----

def line_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the order's customer. Source and row id come along: lines have no unique key to join a side table by."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("measurement_concept_id"),
        (F.col("l_linenumber") % 6).alias("unit_concept_id"),
        F.col("l_quantity").alias("value_as_number"),
        F.nullif(F.col("l_linenumber") % 4, F.lit(0)).alias("value_as_concept_id"),
        F.nullif("l_linestatus", F.lit("O")).alias("operator_concept_id"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person_id"))
    return lines.join(orders, "o_orderkey").withColumnRenamed("o_orderkey", "measurement_id")


def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("measurement_id"), F.col("o_orderpriority").alias("src_id")
    )


def line_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name")
    )


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("concept_id"), F.col("r_name").alias("concept_name")
    )


# ---- surveys: events ----

def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, answer = F.floor(event_number() / 20).cast("int"), event_number() % 5
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("survey"),
        question.alias("question_concept_id"),
        F.concat(F.lit("q"), question.cast("string")).alias("question"),
        answer.alias("answer_concept_id"),
        F.concat(F.lit("a"), answer.cast("string")).alias("answer"),
    )


SURVEY_SQL = f"""survey AS (
  SELECT user_id AS person_id, event_type AS survey, {K_SQL} // 20 AS question_concept_id,
         'q' || CAST({K_SQL} // 20 AS VARCHAR) AS question, {K_SQL} % 5 AS answer_concept_id,
         'a' || CAST({K_SQL} % 5 AS VARCHAR) AS answer
  FROM events)"""
