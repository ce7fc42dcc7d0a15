import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrove.operators import cohort as c
from tallygrove.operators import counts as n
from tallygrove.operators import frames as f
from tallygrove.operators.joins import join_common


def test_cohort_counts(spark, rows):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "a")], "person_id BIGINT, kind STRING")
    cohort = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "person_id BIGINT")
    assert rows(c.count_persons(people, cohort, "n")) == [(2,)]
    assert rows(c.count_persons(people, None, "n")) == [(2,)]
    assert rows(c.count_persons(people, cohort, "n", approximate=True)) == [(2,)]
    assert rows(c.in_cohort(people, cohort)) == [(1, "a"), (2, "b"), (2, "b")]
    assert rows(c.define_cohort(people, F.col("kind") == "b")) == [(2,)]


def test_joins_on_keys_and_prefix(spark, rows):
    left = spark.createDataFrame([("p1", "v1", 1), ("p1", "v2", 2)], "pid STRING, visit STRING, x INT")
    right = spark.createDataFrame([("p1", "v1", 10), ("p2", "v1", 20)], "pid STRING, visit STRING, y INT")
    assert rows(c.join_on_keys(left, right, "pid", "visit")) == [("p1", "v1", 1, 10)]
    assert len(rows(c.join_on_keys(left, right.drop("visit"), "pid", "visit"))) == 2
    subsets = spark.createDataFrame([("p1-7",), ("p3-1",)], "subset STRING")
    assert rows(c.join_on_prefix(subsets, "subset", right.select("pid"), "pid")) == [("p1-7", "p1")]


def test_common_join_matches_missing_keys(spark, rows):
    left = spark.createDataFrame([(1, None, "l1"), (2, "k", "l2"), (None, None, "l3")], "a INT, b STRING, l STRING")
    right = spark.createDataFrame([(1, None, "r1"), (2, "z", "r2"), (None, None, "r3")], "a INT, b STRING, r STRING")
    assert rows(join_common(left, right)) == [(1, None, "l1", "r1"), (None, None, "l3", "r3")]
    with pytest.raises(ValueError):
        join_common(left.select("l"), right.select("r"))


def test_totals_and_small_cells(spark, rows):
    data = [("a", i % 25) for i in range(50)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(data, "kind STRING, person_id INT")
    assert rows(n.count_with_total(df, ["kind"])) == [("a", 50, False), ("b", 3, False), (None, 53, True)]
    assert rows(n.count_with_total(df, ["kind"], "person_id")) == [("a", 25, False), ("b", 3, False), (None, 25, True)]
    hidden = n.hide_small_cells(df, ["kind"], {"n_rows": F.count(F.lit(1))})
    assert rows(hidden) == [("a", 25, 50, False), ("b", None, None, True)]


def test_total_tells_missing_key_from_total(spark, rows):
    df = spark.createDataFrame([(None,), ("a",)], "kind STRING")
    assert rows(n.count_with_total(df, ["kind"])) == [("a", 1, False), (None, 1, False), (None, 2, True)]


def test_top_and_limits(spark, rows):
    df = spark.createDataFrame([("x", 5), ("y", 5), ("x", 1), (None, 9)], "code STRING, score INT")
    assert [tuple(r) for r in n.top_values(df, "code", 1).collect()] == [("x", 2)]
    assert [tuple(r) for r in n.top_scores(df, "score", 2, "code").collect()] == [(None, 9), ("x", 5)]
    many = spark.range(1500)
    assert [n.limit_for(many, m).count() for m in ("explore", "aggregate", "all")] == [100, 1000, 1500]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 40)), min_size=1, max_size=80))
def test_small_cells_never_show_small_groups(spark, data):
    df = spark.createDataFrame(data, "kind STRING, person_id INT")
    shown = n.hide_small_cells(df, ["kind"], {"n_rows": F.count(F.lit(1))}, limit=5).collect()
    for r in shown:
        people = len({p for k, p in data if k == r.kind})
        assert r.suppressed == (people < 5)
        assert (r.n_rows is None) == (people < 5) and r.n_persons == (people if people >= 5 else None)


def test_frames(spark, rows):
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id INT, parts ARRAY<STRING>")
    assert rows(f.lists_to_text(lists)) == [(1, '["a","b"]'), (2, None)]
    texts = spark.createDataFrame([(i, "x" * (i + 49)) for i in range(3)], "id INT, text STRING")
    assert rows(f.preview(texts, order=["id"]), "text") == [("x" * 49,), ("x" * 50,), ("x" * 50 + "...",)]
    assert rows(f.preview_note(texts, 2)) == [(3, "... showing 2 of 3 rows")]
    assert rows(f.preview_note(texts.limit(0))) == [(0, "(No results)")]
    assert rows(f.preview_note(texts)) == [(3, "")]
    live = spark.createDataFrame([(1, "running")], "id INT, status STRING")
    apps = spark.createDataFrame([(1, "x"), (2, "x")], "id INT, status STRING")
    assert rows(f.with_status(apps, live, "id")) == [(1, "running"), (2, "not_found")]


@pytest.mark.parametrize("n_lines", [3, 1200])
def test_last_lines_with_a_hot_source(spark, n_lines):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 10).cast("string")).alias("src"), "id")
    got = f.last_lines(df, "src", ["id"], n_lines).collect()
    hot = sorted((r.id for r in got if r.src == "hot"), reverse=True)
    assert hot == [i for i in range(5999, -1, -1) if i % 3 == 0][:n_lines]
