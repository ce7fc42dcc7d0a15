"""Stored person sets and the latest rows kept by batches, against plain Python and full runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import latest_state, person_sets
from tallygrove.operators.measurement import latest_per_person

ROWS = "person_id LONG, measurement_id LONG, measurement_date DATE, measurement_datetime TIMESTAMP, value_as_number DOUBLE"


def _some(rng, n, first=0):
    out = []
    for k in range(first, first + n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(5000))
        out.append((rng.choice([None, 1, rng.randrange(200)]), k, rng.choice([None, at.date()]), at, float(k)))
    return out


def test_small_sets_are_exact(spark):
    rows = [("a", "x", k) for k in range(50)] + [("a", "y", k) for k in range(25, 100)] + [("b", "x", 7), ("b", "x", 7), ("c", "x", None)]
    table = spark.createDataFrame(rows, "concept STRING, src STRING, person_id LONG").repartition(4)
    fine = person_sets.person_sets(table, ["concept", "src"])
    cohort = person_sets.person_sets(spark.range(40, 60).withColumnRenamed("id", "person_id"), [])
    got = person_sets.count_within(person_sets.merged_sets(fine, ["concept"]), cohort).collect()
    assert {(r.concept, r.n_persons, r.n_within, r.persons_error, r.within_error) for r in got} == {("a", 100, 20, 0, 0), ("b", 1, 0, 0, 0)}
    nobody = person_sets.person_sets(table.where("false"), [])
    assert [(r.n_persons, r.n_within) for r in person_sets.count_within(nobody, cohort).collect()] == [(0, 0)]
    assert {r.n_within for r in person_sets.count_within(fine, nobody).collect()} == {0}


@pytest.mark.parametrize("lg", [6, 9])
def test_large_sets_are_within_the_error(spark, lg):
    table = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(40)).alias("concept"), F.expr("id % 30000").alias("person_id"))
    cohort = table.where("person_id < 9000").select("person_id").distinct()
    exact = {r.concept: (r.n, r.within) for r in table.groupBy("concept").agg(
        F.countDistinct("person_id").alias("n"), F.countDistinct(F.when(F.col("person_id") < 9000, F.col("person_id"))).alias("within")).collect()}
    told = person_sets.count_within(person_sets.person_sets(table, ["concept"], lg=lg), person_sets.person_sets(cohort, [], lg=lg), lg).collect()
    assert len(told) == 40
    for r in told:
        n, within = exact[r.concept]
        assert abs(r.n_persons - n) <= r.persons_error and abs(r.n_within - within) <= r.within_error
        assert r.persons_error < n * 5 * 2 / 2 ** (lg / 2)  # an error worth stating


def test_batches_equal_one_run(spark, tmp_path, rows):
    rng, path = random.Random(8), str(tmp_path / "state")
    batches = [spark.createDataFrame(_some(rng, n, 1000 * k), ROWS).repartition(3) for k, n in enumerate((300, 40, 0, 300))]
    assert latest_state.read_latest(spark, path, batches[0].schema).count() == 0
    whole = batches[0]
    for k, batch in enumerate(batches):
        whole = whole.union(batch) if k else whole
        latest_state.apply_batch(path, batch, k, buckets=16)
        assert rows(latest_state.read_latest(spark, path, batch.schema)) == rows(latest_per_person(whole))
    latest_state.apply_batch(path, batches[0].withColumn("measurement_date", F.lit("2030-01-01").cast("date")), 3, buckets=16)
    assert rows(latest_state.read_latest(spark, path, whole.schema)) == rows(latest_per_person(whole))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, at = tmp_path / "state", dt.datetime(2024, 1, 1)
    latest_state.apply_batch(str(path), spark.createDataFrame([(k, k, at.date(), at, 1.0) for k in range(500)], ROWS), 0, buckets=32)
    latest_state.apply_batch(str(path), spark.createDataFrame([(7, 900, dt.date(2024, 2, 1), at, 2.0)], ROWS), 1, buckets=32)
    assert len(list(path.glob("rows/number=0/bucket=*"))) == 32
    assert [len(list(f.glob("*.parquet"))) for f in path.glob("rows/number=1/bucket=*")] == [1]


def test_a_batch_that_failed_is_not_read(spark, tmp_path, rows):
    path, at = tmp_path / "state", dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([(1, 1, at.date(), at, 1.0)], ROWS)
    latest_state.apply_batch(str(path), first, 0, buckets=4)
    later = spark.createDataFrame([(1, 2, dt.date(2024, 3, 1), at, 2.0)], ROWS)
    latest_state.apply_batch(str(path), later, 1, buckets=4)
    (path / "manifest/1/_SUCCESS").unlink()
    assert rows(latest_state.read_latest(spark, str(path), first.schema)) == rows(first)
    latest_state.apply_batch(str(path), later, 1, buckets=4)
    assert rows(latest_state.read_latest(spark, str(path), first.schema)) == rows(later)


def test_stream_keeps_the_state(spark, tmp_path, rows):
    rng, folder, path = random.Random(9), str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame(_some(rng, 100, 1000 * k), ROWS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
    job = latest_state.write_latest(stream, path, str(tmp_path / "place"), buckets=8, available_now=True)
    job.awaitTermination()
    whole = spark.read.parquet(folder)
    assert job.exception() is None and rows(latest_state.read_latest(spark, path, whole.schema)) == rows(latest_per_person(whole))
