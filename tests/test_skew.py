"""Hot keys: a third of all rows on one person, in the joins that have to carry them."""

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import cohort as c
from tallygrove.operators import frames as f
from tallygrove.operators import measurement as m

_SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.shuffle.partitions": "40",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in _SMALL}
    for k, v in _SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def facts(spark):
    person = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    return spark.range(0, 300_000, numPartitions=8).select(
        "id", person.cast("long").alias("person_id"), F.rand(1).alias("v"), F.current_date().alias("measurement_date"),
        F.current_timestamp().alias("measurement_datetime"), F.col("id").alias("measurement_id"),
    )


def test_semi_join_splits_a_hot_person(spark, small_limits, facts, capsys):
    cohort = spark.range(0, 2500).select(F.col("id").alias("person_id"))
    joined = c.in_cohort(facts, cohort)
    assert len(joined.select("id").collect()) > 100_000
    joined.collect()
    capsys.readouterr()
    joined.explain()
    assert "skew=true" in capsys.readouterr().out


def test_left_join_splits_a_hot_person(spark, small_limits, facts, capsys):
    people = spark.range(0, 5000).select(F.col("id").alias("person_id"), F.lit("x").alias("sex"))
    joined = facts.join(people, "person_id", "left")
    assert len(joined.collect()) == 300_000
    capsys.readouterr()
    joined.explain()
    assert "skew=true" in capsys.readouterr().out


def test_counts_and_ranks_of_a_hot_person(spark, small_limits, facts):
    cohort = spark.range(0, 2500).select(F.col("id").alias("person_id"))
    assert c.count_persons(facts, cohort, "n").first().n == facts.select("person_id").distinct().where("person_id < 2500").count()
    latest = m.latest_per_person(facts)
    assert latest.count() == 5000 and latest.where("person_id = 7").first().measurement_id == 299_997


def test_last_lines_of_a_hot_key_without_pushed_ranks(spark, small_limits, facts):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(name)
    want = sorted(tuple(r) for r in f.last_lines(facts, "person_id", ["id"], 100).where("person_id = 7").select("id", "line_rank").collect())
    spark.conf.set(name, "-1")
    try:
        lines = f.last_lines(facts, "person_id", ["id"], 100)
        assert sorted(tuple(r) for r in lines.where("person_id = 7").select("id", "line_rank").collect()) == want
        assert lines._jdf.queryExecution().executedPlan().toString().count("Window") >= 2
    finally:
        spark.conf.set(name, before)
