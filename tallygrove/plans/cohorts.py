"""Cohort counts, key joins, totals, top values, small cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as c
from ..operators import counts as n
from ..operators import person_sets as sets
from ..session import written
from . import query
from .bind import EVENT_SQL, PERSON_SQL, event_measurements, persons, sexes, table
from ..operators.measurement import persons_with_sex


def _building(spark, sf_dir):
    """Customers of one market segment, by the person key."""
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "person_id")
    return c.define_cohort(customers, F.col("c_mktsegment") == "BUILDING")


COHORT_SQL = "SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("cohort_definition", f"SELECT c_custkey AS person_id FROM ({COHORT_SQL}) AS q")
def cohort_definition(spark, sf_dir):
    return _building(spark, sf_dir)


@query(
    "cohort_total",
    f"SELECT count(DISTINCT c_custkey) AS total_number_of_participants FROM customer WHERE c_custkey IN ({COHORT_SQL})",
)
def cohort_total(spark, sf_dir):
    return c.count_persons(persons(spark, sf_dir), _building(spark, sf_dir), "total_number_of_participants")


@query(
    "cohort_with_orders",
    f"SELECT count(DISTINCT o_custkey) AS number_of_participants_with_orders FROM orders WHERE o_custkey IN ({COHORT_SQL})",
)
def cohort_with_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "person_id")
    return c.count_persons(orders, _building(spark, sf_dir), "number_of_participants_with_orders")


@query(
    "cohort_with_events",
    f"SELECT count(DISTINCT user_id) AS number_of_participants_with_events FROM events WHERE user_id IN ({COHORT_SQL})",
)
def cohort_with_events(spark, sf_dir):
    return c.count_persons(
        event_measurements(spark, sf_dir), _building(spark, sf_dir), "number_of_participants_with_events"
    )


@query(
    "cohort_set_counts",
    f"""SELECT o_orderpriority, count(DISTINCT o_custkey) AS persons,
               count(DISTINCT o_custkey) FILTER (o_custkey IN ({COHORT_SQL})) AS within_cohort, true AS in_bounds
        FROM orders GROUP BY o_orderpriority""",
)
def cohort_set_counts(spark, sf_dir):
    """Exact counts of customers with orders by priority, all and of the cohort, and whether sets stored by priority and status tell them within their errors."""
    orders, building, lg = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "person_id"), _building(spark, sf_dir), 8
    fine = written(sets.person_sets(orders, ["o_orderpriority", "o_orderstatus"], lg=lg), "person-sets")
    told = sets.count_within(sets.merged_sets(fine, ["o_orderpriority"], lg), sets.person_sets(building, [], lg=lg), lg)
    pairs = orders.select("o_orderpriority", "person_id").where("person_id IS NOT NULL").distinct()
    known = pairs.join(building.select(F.col("person_id").alias("member")), F.col("person_id") == F.col("member"), "left")
    exact = known.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("persons"), F.count("member").alias("within_cohort"))
    near = (F.abs(F.col("n_persons") - F.col("persons")) <= F.col("persons_error")) & (F.abs(F.col("n_within") - F.col("within_cohort")) <= F.col("within_error"))
    return exact.join(told, "o_orderpriority").select("o_orderpriority", "persons", "within_cohort", near.alias("in_bounds"))


@query(
    "visit_join",
    """SELECT l_orderkey AS visit_id, l_linenumber AS line, l_partkey, o_custkey AS person_id, o_orderstatus AS status
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def visit_join(spark, sf_dir):
    visits = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("status")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("visit_id"), F.col("l_linenumber").alias("line"), "l_partkey"
    )
    return c.join_on_keys(lines, visits, "visit_id")


@query(
    "person_visit_join",
    """WITH firsts AS (SELECT DISTINCT o_custkey AS person_id, year(o_orderdate) AS visit FROM orders
                       WHERE o_orderpriority = '1-URGENT'),
            rows_ AS (SELECT o_custkey AS person_id, year(o_orderdate) AS visit, o_orderkey, o_totalprice FROM orders)
       SELECT person_id, visit, o_orderkey, o_totalprice FROM firsts JOIN rows_ USING (person_id, visit)""",
)
def person_visit_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_id"), F.year("o_orderdate").alias("visit"),
        "o_orderkey", "o_totalprice", "o_orderpriority",
    )
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").select("person_id", "visit").distinct()
    return c.join_on_keys(urgent, orders.drop("o_orderpriority"), "person_id", "visit")


@query(
    "prefix_join",
    """SELECT subset_id, c_name, value FROM (
         SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS subset_id, value FROM events) AS e
       JOIN customer ON split_part(subset_id, '-', 1) = 'u' || CAST(c_custkey AS VARCHAR)""",
)
def prefix_join(spark, sf_dir):
    subsets = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.col("event_id")).alias("subset_id"), "value"
    )
    people = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey")).alias("participant_id"), "c_name"
    )
    return c.join_on_prefix(subsets, "subset_id", people, "participant_id").drop("participant_id")


@query(
    "count_with_total",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BOOLEAN) AS is_total
       FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""",
)
def count_with_total(spark, sf_dir):
    return n.count_with_total(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "persons_with_total",
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, CAST(grouping(o_orderpriority) AS BOOLEAN) AS is_total
       FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""",
)
def persons_with_total(spark, sf_dir):
    return n.count_with_total(table(spark, sf_dir, "orders"), ["o_orderpriority"], person="o_custkey")


@query(
    "top_values",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10",
)
def top_values(spark, sf_dir):
    return n.top_values(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@query(
    "top_scores",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
)
def top_scores(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return n.top_scores(customers, "c_acctbal", 10, "c_custkey")


def _complements_sql(source: str, persons: str, figures: dict[str, str], chain: list[list[str]], limit: int = 20) -> str:
    """Groups and nested totals of a relation as CTEs, the last of them ``shown``, with what must not be told hidden."""
    out, state = [], {}
    for i, keys in enumerate(chain):
        listed = "".join(f"{k}, " for k in keys)
        made = ", ".join(f"{sql} AS {name}" for name, sql in figures.items())
        out.append(f"g{i} AS (SELECT {listed}{persons} AS persons, {made}, {persons} < {limit} AS gone FROM {source}{' GROUP BY ' + listed[:-2] if keys else ''})")
        state[i] = f"g{i}"

    def step(i: int, tag: str, chosen: str, lost: str) -> None:
        names, own = chain[i], [k for k in chain[i - 1] if k not in chain[i]]
        part = "{" + ", ".join(f"'{k}': {k}" for k in ["persons", *own]) + "}"
        listed = "".join(f"{k}, " for k in names)
        same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in names) or "true"
        below, total = state[i - 1], state[i]
        out.append(f"s{tag} AS (SELECT {listed}count(*) FILTER (gone) AS h, sum(persons) FILTER (gone) AS s, min({part}) FILTER (NOT gone) AS next FROM {below}{' GROUP BY ' + listed[:-2] if names else ''})")
        out.append(f"t{tag} AS (SELECT x.* EXCLUDE (gone), gone OR ({lost}) AS gone, CASE WHEN {chosen} THEN next END AS pick FROM {total} x JOIN s{tag} y ON {same})")
        out.append(f"p{tag} AS (SELECT x.* EXCLUDE (gone), x.gone OR coalesce({part.replace(': ', ': x.')} = pick, false) AS gone FROM {below} x JOIN t{tag} y ON {same})")
        out.append(f"u{tag} AS (SELECT * EXCLUDE (pick) FROM t{tag})")
        state[i - 1], state[i] = f"p{tag}", f"u{tag}"

    few = f"NOT gone AND h >= 1 AND (h < 2 OR s < {limit})"
    for i in range(1, len(chain)):
        step(i, f"up{i}", few, f"{few} AND next IS NULL")
    for i in range(len(chain) - 1, 0, -1):
        step(i, f"down{i}", "gone AND h = 0", "false")
    parts = [
        f"SELECT {', '.join(k if k in keys else f'NULL AS {k}' for k in chain[0])}, {len(keys)} AS n_keys, CASE WHEN NOT gone THEN persons END AS n_persons, "
        + ", ".join(f"CASE WHEN NOT gone THEN {name} END AS {name}" for name in figures) + f", gone AS suppressed FROM {state[i]}"
        for i, keys in enumerate(chain)
    ]
    return ", ".join([*out, "shown AS (" + " UNION ALL ".join(parts) + ")"])


_CELL_CHAIN = [["sex_at_birth", "measurement_concept_id"], ["measurement_concept_id"]]


@query(
    "small_cells",
    f"""WITH {PERSON_SQL}, {EVENT_SQL}, rows AS (SELECT * FROM meas JOIN person USING (person_id)),
        {_complements_sql("rows", "count(DISTINCT person_id)", {"n_rows": "count(*)", "mean_value": "round(avg(value_as_number), 6)"}, _CELL_CHAIN)}
        SELECT CASE WHEN n_keys = 1 THEN 'all' ELSE sex_at_birth END AS sex_at_birth, measurement_concept_id, n_persons, n_rows, mean_value, suppressed FROM shown""",
)
def small_cells(spark, sf_dir):
    rows = event_measurements(spark, sf_dir).join(persons_with_sex(persons(spark, sf_dir), sexes(spark, sf_dir)), "person_id")
    figures = {"n_rows": F.count(F.lit(1)), "mean_value": F.round(F.avg("value_as_number"), 6)}
    keys = ["sex_at_birth", "measurement_concept_id"]
    both = n.hide_small_cells(rows, keys, figures, also=[["measurement_concept_id"]])
    by_sex = F.array_contains("grouped_by", "sex_at_birth")
    return both.withColumn("sex_at_birth", F.when(by_sex, F.col("sex_at_birth")).otherwise("all")).drop("grouped_by")


_ROLLED_CHAIN = [["priority", "year", "status"], ["priority", "year"], ["priority"], []]


@query(
    "rolled_cells",
    f"""WITH rows AS (SELECT o_custkey, o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, o_totalprice FROM orders),
        {_complements_sql("rows", "count(DISTINCT o_custkey)", {"n_orders": "count(*)", "cents": "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT)"}, _ROLLED_CHAIN)}
        SELECT priority, year, status, n_keys, n_persons, n_orders, cents, suppressed FROM shown""",
)
def rolled_cells(spark, sf_dir):
    """Customers and orders by priority, year and status with three levels of totals; small groups and what would tell them are hidden."""
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    figures = {"n_orders": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))}
    cells = n.hide_small_cells(rows, _ROLLED_CHAIN[0], figures, "o_custkey", also=_ROLLED_CHAIN[1:])
    return cells.withColumn("n_keys", F.size("grouped_by")).drop("grouped_by")
