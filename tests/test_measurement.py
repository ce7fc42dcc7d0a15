import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import ages as a
from tallygrove.operators import boxplot as b
from tallygrove.operators import measurement as m
from tallygrove.operators import profile as p
from tallygrove.operators import survey as s
from tallygrove.operators import quantiles
from tallygrove.operators.profile import column_profile
from tallygrove.operators.quantiles import count_values, group_quantiles, quantiles_of_counts
from tallygrove.session import stored


@pytest.fixture(scope="module")
def skewed(spark):
    """A group with a third of all rows and all values different, a group of one value, a missing group."""
    rng = random.Random(7)
    data = [("hot", rng.lognormvariate(3, 2)) for _ in range(4000)]
    data += [("flat", 5.0)] * 3000 + [(None, float(i % 37)) for i in range(3000)]
    data += [(f"g{i % 40}", rng.choice([None, float(i), -1.5])) for i in range(2000)] + [("empty", None)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k STRING, v DOUBLE").repartition(6).cache()


def _by_group(data):
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return groups


@pytest.mark.parametrize("interpolation", ["linear", "discrete"])
def test_exact_quantiles(skewed, interpolation):
    data, df = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.k: (r.n, r.quantiles) for r in group_quantiles(df, ["k"], "v", probs, interpolation).collect()}
    want = _by_group(data)
    assert set(got) == set(want)
    method = "linear" if interpolation == "linear" else "inverted_cdf"
    for k, values in want.items():
        assert got[k][0] == len(values)
        assert np.allclose(got[k][1], np.quantile(values, probs, method=method), rtol=1e-12)


def test_quantiles_overall_and_sketch(skewed):
    data, df = skewed
    values = [v for _, v in data if v is not None]
    row = group_quantiles(df, [], "v", [0.1, 0.5]).first()
    assert row.n == len(values) and np.allclose(row.quantiles, np.quantile(values, [0.1, 0.5]))
    flat = group_quantiles(df.where("k = 'flat'"), ["k"], "v", [0.5]).first()
    assert (flat.n, flat.quantiles) == (3000, [5.0])
    approx = group_quantiles(df.where("k = 'hot'"), ["k"], "v", [0.5], method="approx").first().quantiles[0]
    ordered = sorted(v for k, v in data if k == "hot")
    rank = sum(v < approx for v in ordered) / len(ordered)
    assert abs(rank - 0.5) < 0.001


@pytest.mark.parametrize("limit", [3, 50, 100_000])
def test_quantiles_do_not_depend_on_what_a_task_sorts(skewed, limit):
    data, df = skewed
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    counted = stored(count_values(df, ["k"], "v"))
    got = {r.g.k: r.quantiles for r in quantiles_of_counts(counted, probs, limit=limit).collect()}
    whole = {r.g.k: r.quantiles for r in quantiles_of_counts(counted, probs).collect()}
    assert got == whole


def test_no_part_is_larger_than_what_a_task_sorts(skewed, monkeypatch):
    data, df = skewed
    seen = []
    picked = quantiles._picked
    monkeypatch.setattr(quantiles, "_picked", lambda running, ranks: seen.append(running) or picked(running, ranks))
    narrowed = quantiles._narrowed
    sizes = []

    def watch(parts, ranks, limit):
        finer = narrowed(parts, ranks, limit)
        if finer is None:
            sizes.append(parts.groupBy("g", "part").count().agg(F.max("count")).first()[0])
        return finer

    monkeypatch.setattr(quantiles, "_narrowed", watch)
    quantiles_of_counts(stored(count_values(df, ["k"], "v")), [0.25, 0.5, 0.75], limit=40).collect()
    assert sizes and sizes[0] <= 40


def test_box_figures(skewed):
    data, df = skewed
    got = {r.k: r for r in b.box_figures(df, ["k"], "v", method="exact").collect()}
    for k, values in _by_group(data).items():
        q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        r = got[k]
        assert np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, q2, q3, min(inside), max(inside)])
        assert (r.n, r.outliers, r.y, r.label) == (len(values), len(values) - len(inside), max(values), f"N = {len(values)}")


def test_summary(spark, rows):
    measurement = spark.createDataFrame(
        [
            (1, 1, 10, 7, 1.0, None, None), (2, 1, 10, 7, 3.0, 0, 5), (3, 2, 10, 7, None, None, None),
            (4, 2, 10, 7, None, 4, None), (5, 2, 10, 8, 2.0, None, None), (6, 2, 10, None, 9.0, None, None),
            (7, 3, 11, 7, 1.0, None, None),
        ],
        "measurement_id INT, person_id INT, measurement_concept_id INT, unit_concept_id INT, value_as_number DOUBLE, "
        "value_as_concept_id INT, operator_concept_id INT",
    )
    concept = spark.createDataFrame([(10, "HemoGlobin A1c"), (11, "glucose"), (7, "percent")], "concept_id INT, concept_name STRING")
    ext = spark.createDataFrame([(1, "PPI/PM"), (2, "site")], "measurement_id INT, src_id STRING")
    for method in ("exact", "approx"):
        found = m.measurement_summary(measurement, concept, ext, "hemoglobin", method=method)
        got = {(r.unit, r.measurement_source): r for r in found.collect()}
        assert set(got) == {("percent", "PPI"), ("percent", "EHR"), ("NA", "EHR")}
        r = got[("percent", "EHR")]
        assert (r.N, r.missing, r.num_numeric_values, r.num_concept_values, r.num_operators) == (3, 1, 1, 1, 1)
        assert (r.min, r.max, r.avg, r.stddev, r.quantiles) == (3.0, 3.0, 3.0, None, [3.0] * 5)
    cohort = spark.createDataFrame([(1,)], "person_id INT")
    assert m.measurement_summary(measurement, concept, ext, "hemoglobin", cohort).agg(F.sum("N")).first()[0] == 2
    used = m.concepts_in_use(measurement, concept, "hemoglobin")
    assert rows(used, "unit_concept_id", "unit_name") == [(7, "percent"), (8, None), (None, None)]


def test_rows_and_most_recent(spark, rows):
    day = dt.date(2020, 1, 2)
    measurement = spark.createDataFrame(
        [
            (1, 1, 10, 7, day, None, 1.0), (2, 1, 10, 7, day, dt.datetime(2020, 1, 2, 3), 2.0),
            (3, 1, 10, 7, day, dt.datetime(2020, 1, 2, 3), 3.0), (4, 1, 10, 7, None, None, 4.0), (5, 9, 10, 7, day, None, 5.0),
            (6, 1, 10, 8, dt.date(2021, 1, 1), None, 6.0),
        ],
        "measurement_id INT, person_id INT, measurement_concept_id INT, unit_concept_id INT, measurement_date DATE, "
        "measurement_datetime TIMESTAMP, value_as_number DOUBLE",
    )
    person = spark.createDataFrame([(1, day, 77)], "person_id INT, birth_datetime DATE, sex_at_birth_concept_id INT")
    concept = spark.createDataFrame([(5, "x")], "concept_id INT, concept_name STRING")
    ext = spark.createDataFrame([(3, "s3")], "measurement_id INT, src_id STRING")
    every = m.measurement_rows(measurement, person, concept, ext, 10, 7)
    assert rows(every, "person_id", "value_as_number") == [(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (None, 5.0)]
    assert "measurement_id" not in every.columns
    latest = m.most_recent(measurement, person, concept, ext, 10, 7)
    assert rows(latest, "person_id", "src_id", "value_as_number") == [(1, "s3", 3.0), (None, None, 5.0)]
    cohort = spark.createDataFrame([(1,)], "person_id INT")
    assert m.most_recent(measurement, person, concept, ext, 10, 7, cohort).count() == 1


def test_most_recent_limits_before_the_shuffle(spark, capsys):
    df = spark.range(1000).selectExpr("id % 3 AS person_id", "current_date() AS measurement_date", "now() AS measurement_datetime", "id AS measurement_id")
    m.latest_per_person(df).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2


def test_ages(spark):
    cases = [
        (dt.date(2000, 2, 29), dt.date(2001, 2, 28), 0), (dt.date(2000, 2, 29), dt.date(2001, 3, 1), 1),
        (dt.date(2000, 5, 5), dt.date(2020, 5, 4), 19), (dt.date(2000, 5, 5), dt.date(2020, 5, 5), 20),
        (dt.date(2000, 1, 31), dt.date(2001, 1, 30), 0), (None, dt.date(2001, 1, 1), None),
    ]
    df = spark.createDataFrame(cases, "birth DATE, event DATE, want INT")
    assert all(r.got == r.want for r in df.withColumn("got", a.age_by_calendar(F.col("event"), F.col("birth"))).collect())
    born, when = dt.datetime(2000, 1, 1, 13), dt.datetime(2020, 6, 1, 9)
    one = spark.createDataFrame([(born, when)], "birth TIMESTAMP, event TIMESTAMP")
    got = one.select(
        a.age_by_days(F.col("event"), F.col("birth")), a.age_today(F.col("birth"), F.lit("2024-01-01").cast("date"))
    ).first()
    assert tuple(got) == (math.floor((when - born).days / 365.24), 24)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0, 10, 11, 34, 35, 49, 50, 64, 65, 120)], "age INT")
    bands = [tuple(r) for r in df.select(a.age_band(F.col("age")), a.width_band(F.col("age"), 10, 0), a.width_band(F.col("age"), 5, 0)).collect()]
    assert [x[0] for x in bands] == [None] + ["<35"] * 4 + ["35-49"] * 2 + ["50-64"] * 2 + ["65+"] * 2
    assert [x[1] for x in bands[:5]] == [None, "[0,10]", "[0,10]", "(10,20]", "(30,40]"]
    assert [x[2] for x in bands[:4]] == [None, "[0,5]", "(5,10]", "(10,15]"]


@pytest.mark.parametrize(
    "ages, width, want",
    [
        ([18, 20, 21], 10, ["[10,20]", "[10,20]", "(20,30]"]), ([20, 30, 31], 10, ["[20,30]", "[20,30]", "(30,40]"]),
        ([0, 10, 11], 10, ["[0,10]", "[0,10]", "(10,20]"]), ([-3, 0, 10], 10, ["[-10,0]", "[-10,0]", "(0,10]"]), ([18, 20, 25], 5, ["[15,20]", "[15,20]", "(20,25]"]),
    ],
)
def test_width_bands_start_at_the_least_age(spark, ages, width, want):
    df = spark.createDataFrame([(x,) for x in ages], "age INT")
    assert [r[0] for r in df.select(a.width_band(F.col("age"), width, min(ages))).collect()] == want


def test_profile_of_nested_columns(spark):
    df = spark.createDataFrame([([1.0], b"x", 3), (None, b"y", None)], "v ARRAY<DOUBLE>, raw BINARY, n INT")
    for method in ("approx", "exact"):
        got = {r.column: (r.n, r.missing, r.n_distinct, r.max) for r in column_profile(df, method=method).collect()}
        assert got == {"v": (1, 1, None, None), "raw": (2, 0, None, None), "n": (1, 1, 1, 3.0)}
    assert column_profile(df.select("v"), method="exact").count() == 1


def test_plot_rows(spark, rows):
    data = [
        ("c", "mg", "F", 1.0), ("c", None, "F", 2.0), ("c", "No matching concept", "F", 3.0), ("c", "NULL", "F", 4.0),
        ("c", "mg", None, 5.0), ("c", "mg", "No matching concept", 6.0), ("c", "mg", "M", 9999999.0), ("c", "mg", "M", None),
        ("d", "mg", "M", 7.0),
    ]
    df = spark.createDataFrame(data, "standard_concept_name STRING, unit_concept_name STRING, sex_at_birth STRING, value_as_number DOUBLE")
    assert rows(m.plot_rows(df, "c"), "value_as_number") == [(1.0,), (4.0,), (5.0,)]
    assert rows(m.plot_rows(df, "c", null_policy="drop_sex"), "value_as_number") == [(1.0,), (2.0,)]
    assert rows(m.plot_rows(df, "c", sex=None), "value_as_number") == [(1.0,), (4.0,), (5.0,), (6.0,)]
    aged = df.withColumn("age", F.when(F.col("value_as_number") < 5, 40))
    assert rows(m.plot_rows(aged, "c", age="age"), "value_as_number") == [(1.0,), (4.0,)]
    first = m.first_concept(df, "standard_concept_name", "value_as_number")
    assert rows(first) == [("c",)]
    assert rows(m.plot_rows(df, first), "value_as_number") == [(1.0,), (4.0,), (5.0,)]


def test_surveys(spark, rows):
    data = [
        (1, "The Basics", 5, "q5", 1, "yes"), (1, "The Basics", 5, "q5", 1, "yes"), (2, "The Basics", 5, "q5", None, "skip"),
        (None, "The Basics", 5, "q5", 1, "yes"), (3, "Lifestyle", 6, "q6", 2, "no"),
    ]
    df = spark.createDataFrame(data, "person_id INT, survey STRING, question_concept_id BIGINT, question STRING, answer_concept_id BIGINT, answer STRING")
    assert rows(s.question_counts(df, 5, 3)) == [(1, "yes", 1, 33.33)]
    assert rows(s.question_counts(df, 5, 3, keep_missing=True, as_text=True)) == [(1, "yes", 2, "66.67%"), (None, "skip", 1, "33.33%")]
    assert s.question_counts(df, 99).count() == 0
    assert rows(s.question_known(df, 99)) == [(False, None)] and rows(s.question_known(df, 5)) == [(True, "q5")]
    assert rows(s.module_counts(df, "the basics", 0)) == [("The Basics", 5, "q5", 2)]
    assert len(rows(s.module_counts(df))) == 2


def test_profile(spark):
    data = [(i, float(i % 10) if i % 4 else None, f"t{i % 3}", i % 2 == 0) for i in range(100)]
    df = spark.createDataFrame(data, "id INT, v DOUBLE, t STRING, b BOOLEAN")
    values = [v for _, v, _, _ in data if v is not None]
    for method in ("exact", "approx"):
        got = {r.column: r for r in p.column_profile(df, method).collect()}
        assert set(got) == {"id", "v", "t", "b"}
        assert (got["v"].n, got["v"].missing, got["t"].n_distinct, got["b"].n_distinct) == (75, 25, 3, 2)
        assert np.isclose(got["v"].mean, np.mean(values)) and np.isclose(got["v"].stddev, np.std(values, ddof=1))
        assert got["t"].mean is None and (got["id"].min, got["id"].max) == (0.0, 99.0)
    assert np.isclose({r.column: r for r in p.column_profile(df, "exact").collect()}["id"].q1, 24.75)
    assert {r.n for r in p.column_profile(df, rows=10, order=["id"]).where("column = 'id'").collect()} == {10}
    assert tuple(p.frame_shape(df).first()) == (100, 4)
    empty = p.column_profile(df.limit(0)).collect()
    assert len(empty) == 4 and {r.n for r in empty} == {0}
