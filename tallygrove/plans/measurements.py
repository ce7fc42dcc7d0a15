"""Measurement summary, rows, most recent rows, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest_state
from ..operators import measurement as m
from ..operators.quantiles import group_quantiles
from ..session import scratch_path
from . import query
from .bind import (
    EVENT_SQL, PERSON_SQL, as_text, event_measurements, event_sources, line_concepts, line_measurements, line_sources,
    line_units, persons, quartile_columns, rounded, sexes, table,
)
from .cohorts import COHORT_SQL, _building

_LINES_SQL = """meas AS (
  SELECT l_partkey AS measurement_concept_id, l_linenumber % 6 AS unit_concept_id, l_quantity AS v,
         nullif(l_linenumber % 4, 0) AS c, nullif(l_linestatus, 'O') AS op,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'PPI' ELSE 'EHR' END AS measurement_source, o_custkey AS person_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
labs AS (
  SELECT DISTINCT measurement_concept_id, unit_concept_id, p_name AS measurement, r_name AS unit_name
  FROM meas LEFT JOIN part ON p_partkey = measurement_concept_id LEFT JOIN region ON r_regionkey = unit_concept_id
  WHERE regexp_matches(p_name, '(?i)RING'))"""


def _summary_sql(where: str, quantile: str) -> str:
    return f"""WITH {_LINES_SQL}
SELECT measurement, coalesce(unit_name, 'NA') AS unit, count(*) AS N,
       count(*) FILTER (v IS NULL AND (c IS NULL OR c = 0)) AS missing,
       min(v) AS min, max(v) AS max, round(avg(v), 6) AS avg, round(stddev_samp(v), 6) AS stddev,
       count(*) FILTER (v IS NOT NULL) AS num_numeric_values,
       count(*) FILTER (c IS NOT NULL AND c <> 0) AS num_concept_values,
       count(*) FILTER (op IS NOT NULL) AS num_operators,
       measurement_source, measurement_concept_id, unit_concept_id,
       {", ".join(f"round({quantile}(v, {p}), 6) AS {n}" for p, n in
                  zip((0.0, 0.25, 0.5, 0.75, 1.0), ("q_min", "q1", "q_median", "q3", "q_max")))}
FROM meas JOIN labs USING (measurement_concept_id, unit_concept_id)
{where}
GROUP BY measurement_concept_id, measurement, measurement_source, unit_concept_id, unit_name"""


def _summary(spark, sf_dir, cohort=None, **options):
    summary = m.measurement_summary(
        line_measurements(spark, sf_dir), line_concepts(spark, sf_dir), line_sources(spark, sf_dir), "ring",
        cohort=cohort, unit_concept=line_units(spark, sf_dir), program_source="5-LOW", **options,
    )
    return rounded(quartile_columns(summary), "avg", "stddev", "q_min", "q1", "q_median", "q3", "q_max")


@query("measurement_summary", _summary_sql("", "quantile_cont"))
def measurement_summary(spark, sf_dir):
    return _summary(spark, sf_dir, method="exact")


@query(
    "measurement_summary_cohort",
    _summary_sql(f"WHERE person_id IN ({COHORT_SQL})", "quantile_disc"),
)
def measurement_summary_cohort(spark, sf_dir):
    return _summary(spark, sf_dir, _building(spark, sf_dir), method="exact", interpolation="discrete")


@query("measurement_summary_sketch", _summary_sql("", "quantile_disc"))
def measurement_summary_sketch(spark, sf_dir):
    """One pass with sketches; groups smaller than a sketch, as here, give exact ranks."""
    return _summary(spark, sf_dir, method="approx")


@query(
    "concepts_in_use",
    f"WITH {_LINES_SQL} SELECT measurement_concept_id, unit_concept_id, measurement AS measurement_name, unit_name FROM labs",
)
def concepts_in_use(spark, sf_dir):
    lines, parts = line_measurements(spark, sf_dir), line_concepts(spark, sf_dir)
    pairs = m.concepts_in_use(lines, parts, "ring").drop("unit_name")
    units = line_units(spark, sf_dir).select(
        F.col("concept_id").alias("unit_concept_id"), F.col("concept_name").alias("unit_name")
    )
    return pairs.join(units, "unit_concept_id", "left")


_ROW_COLUMNS = """person_id, CAST(birth_datetime AS VARCHAR) AS birth_datetime, sex_at_birth, src_id, measurement_concept_id,
       unit_concept_id, CAST(measurement_date AS VARCHAR) AS measurement_date,
       strftime(measurement_datetime, '%Y-%m-%d %H:%M:%S.%f') AS measurement_datetime, value_as_number"""


def _shown(df):
    stamped = df.withColumn("measurement_datetime", F.date_format("measurement_datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return as_text(stamped, "birth_datetime", "measurement_date")


@query(
    "measurement_rows",
    f"""WITH {PERSON_SQL}, {EVENT_SQL}
        SELECT {_ROW_COLUMNS} FROM meas LEFT JOIN person USING (person_id)
        WHERE measurement_concept_id = 'view' AND unit_concept_id = 1""",
)
def measurement_rows(spark, sf_dir):
    return _shown(
        m.measurement_rows(
            event_measurements(spark, sf_dir), persons(spark, sf_dir), sexes(spark, sf_dir), event_sources(spark, sf_dir),
            "view", 1,
        )
    )


@query(
    "most_recent",
    f"""WITH {PERSON_SQL}, {EVENT_SQL}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY measurement_date DESC NULLS LAST,
                    measurement_datetime DESC NULLS LAST, measurement_id DESC NULLS LAST) AS recency_rank
          FROM meas WHERE measurement_concept_id = 'view' AND unit_concept_id = 1)
        SELECT {_ROW_COLUMNS} FROM ranked LEFT JOIN person USING (person_id) WHERE recency_rank = 1""",
)
def most_recent(spark, sf_dir):
    return _shown(
        m.most_recent(
            event_measurements(spark, sf_dir), persons(spark, sf_dir), sexes(spark, sf_dir), event_sources(spark, sf_dir),
            "view", 1,
        )
    )


LATEST_ORDER_SQL = """SELECT person_id, measurement_id, CAST(measurement_date AS VARCHAR) AS measurement_date, value_as_number FROM (
         SELECT o_custkey AS person_id, o_orderkey AS measurement_id, CAST(o_orderdate AS DATE) AS measurement_date,
                o_totalprice AS value_as_number,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency_rank
         FROM orders) AS q WHERE recency_rank = 1"""


def _order_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("measurement_id"),
        F.to_date("o_orderdate").alias("measurement_date"), F.col("o_orderdate").alias("measurement_datetime"),
        F.col("o_totalprice").alias("value_as_number"),
    )


@query("latest_order_per_person", LATEST_ORDER_SQL)
def latest_order_per_person(spark, sf_dir):
    return as_text(m.latest_per_person(_order_rows(spark, sf_dir)).drop("measurement_datetime"), "measurement_date")


@query("latest_order_in_batches", LATEST_ORDER_SQL)
def latest_order_in_batches(spark, sf_dir):
    """All orders in three batches, the old ones not always first, into a state that each brings up to date."""
    orders, path = _order_rows(spark, sf_dir), scratch_path(spark, "latest-orders")
    for number, part in enumerate(("month(measurement_date) > 8", "month(measurement_date) < 5", "coalesce(month(measurement_date), 5) BETWEEN 5 AND 8")):
        latest_state.apply_batch(path, orders.where(part), number, buckets=16)
    return as_text(latest_state.read_latest(spark, path, orders.schema).drop("measurement_datetime"), "measurement_date")


@query(
    "first_concept",
    "SELECT event_type AS standard_concept_name FROM events ORDER BY event_id LIMIT 1",
)
def first_concept(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "standard_concept_name")
    return m.first_concept(events, "standard_concept_name", "event_id")


_PRICE_QUANTILES = ", ".join(
    f"round({kind}(l_extendedprice, {p}), 6) AS {name}"
    for kind, p, name in (
        ("quantile_cont", 0.25, "q1"), ("quantile_cont", 0.5, "median"), ("quantile_cont", 0.99, "p99"),
    )
)


@query(
    "price_quantiles",
    f"SELECT l_returnflag, count(l_extendedprice) AS n, {_PRICE_QUANTILES} FROM lineitem GROUP BY l_returnflag",
)
def price_quantiles(spark, sf_dir):
    found = group_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.99])
    return found.select(
        "l_returnflag", "n", *[F.round(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("q1", "median", "p99"))]
    )


@query(
    "price_quantiles_overall",
    """SELECT count(l_extendedprice) AS n, round(quantile_disc(l_extendedprice, 0.1), 6) AS p10,
              round(quantile_disc(l_extendedprice, 0.5), 6) AS p50, round(quantile_disc(l_extendedprice, 0.9), 6) AS p90
       FROM lineitem""",
)
def price_quantiles_overall(spark, sf_dir):
    found = group_quantiles(
        table(spark, sf_dir, "lineitem"), [], "l_extendedprice", [0.1, 0.5, 0.9], interpolation="discrete"
    )
    return found.select("n", *[F.round(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("p10", "p50", "p90"))])


@query(
    "sketch_rank_error",
    "SELECT l_returnflag, count(*) AS n, true AS within_bound FROM lineitem GROUP BY l_returnflag",
)
def sketch_rank_error(spark, sf_dir):
    """Whether the sketched quartiles of large groups lie within the sketch's stated rank error.

    Ranks are whole, so the stated share of the rows is rounded up to a row: a quartile may be that many rows off.
    """
    lines, probs, accuracy = table(spark, sf_dir, "lineitem"), [0.25, 0.5, 0.75], 1000
    rough = group_quantiles(lines, ["l_returnflag"], "l_extendedprice", probs, method="approx", accuracy=accuracy)
    price = F.col("l_extendedprice")
    met = lines.join(rough.drop("n"), "l_returnflag").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(price < F.col("quantiles")[i]).alias(f"below{i}") for i in range(3)],
        *[F.count_if(price <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(3)],
    )
    rows, good = F.ceil(F.col("n") / accuracy), F.lit(True)
    for i, p in enumerate(probs):
        good = good & (F.col(f"below{i}") <= p * F.col("n") + rows) & (F.col(f"upto{i}") >= p * F.col("n") - rows)
    return met.select("l_returnflag", "n", good.alias("within_bound"))
