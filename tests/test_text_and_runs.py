import pytest
from pyspark.sql import functions as F

from tallygrove.constants import ERROR_LENGTH
from tallygrove.functions import text as t
from tallygrove.functions.paths import last_part, megabytes
from tallygrove.operators import registry as r
from tallygrove.operators import runlog as g
from tallygrove.operators import texts as o


def _one(spark, value, function):
    return spark.createDataFrame([(value,)], "x STRING").select(function(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a ```sql\nSELECT 1\n``` b ```sql\nSELECT 2```", "SELECT 1"), ("```sql  \n\n x  \n```", "x"), ("```\nwith a\n```", "with a"),
        ("```\nhello\n```", None), ("no block", None), ("```sql\n```", ""), ("```sql SELECT 1```", None), (None, None),
        ("```\nplain\n``` then ```sql\ninsert\n```", "insert"), ("```sql\nnever closed", None),
    ],
)
def test_sql_block(spark, text, want):
    assert _one(spark, text, t.sql_block) == want


def test_marked_sql(spark):
    assert _one(spark, "```\nselect 1\n```", t.marked_sql) == "" and _one(spark, "```sql\nselect 1\n```", t.marked_sql) == "select 1"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("400 POST: 404 x", "POST: 404 x"), (" at line\n500\n\nbad ", "at line\nbad"), ("no code", "no code"), ("12 34", "12 34"),
        ("y" * 1001, "y" * ERROR_LENGTH + "... (truncated)"), ("404 " + "z" * 1000, "z" * 1000), ("1234 x", "1x"),
    ],
)
def test_clean_error(spark, text, want):
    assert _one(spark, text, t.clean_error) == want


def test_join_parts(spark):
    df = spark.createDataFrame([([("text", "a"), ("image", None), ("text", "b")],), ([],), (None,)], "p ARRAY<STRUCT<type: STRING, text: STRING>>")
    assert [x[0] for x in df.select(t.join_parts(F.col("p"))).collect()] == ['a\n{"type":"image"}\nb', "", ""]


def _cells(spark, text):
    df = spark.createDataFrame([(1, text)], "id INT, text STRING")
    found = o.table_cells(df, "text", ["id"]).orderBy("row_no", "column_no").collect()
    table = {}
    for c in found:
        table.setdefault(c.row_no, {})[c.column_name] = c.value
    return [table[k] for k in sorted(table)]


def test_pipe_tables(spark):
    text = "intro\n| a | b |\n|---+---|\n| 1 | x y |\nnote\n| 2 | |\n| 3 | z |\n\n| 4 | late |"
    assert _cells(spark, text) == [{"a": "1", "b": "x y"}, {"a": "3", "b": "z"}]
    assert _cells(spark, "a | b\n1 | 2") == [{"a": "1", "b": "2"}]
    assert _cells(spark, "| only | header |") == [] and _cells(spark, "nothing") == [] and _cells(spark, None) == []


def test_csv_tables(spark):
    head = "Query successful: 2 rows returned (1 MB)\n\n"
    assert _cells(spark, head + 'a,b\n1,"x, ""y""\nz"\n\n2,') == [{"a": "1", "b": 'x, "y"\nz'}, {"a": "2", "b": ""}]
    assert _cells(spark, head + "a,b\n1") == [{"a": "1", "b": None}]
    assert _cells(spark, head + "a,b\n1,2,3") == []
    assert _cells(spark, head + "a|b\n1|2") == [{"a": "1", "b": "2"}]


def test_long_quoted_csv(spark):
    text = "5 rows returned\n\na,b\n" + "".join(f'{i},"v,{i}"\n' for i in range(5000))
    df = spark.createDataFrame([(1, text)], "id INT, text STRING")
    assert o.table_cells(df, "text", ["id"]).where("column_no = 1").count() == 5000


def test_small_functions(spark):
    assert _one(spark, "a.b.c", last_part) == "c" and _one(spark, "abc", last_part) is None
    assert spark.createDataFrame([(1572864,)], "b BIGINT").select(megabytes(F.col("b"))).first()[0] == 1.5


def test_row_rules(spark, rows):
    good = ("ok-app", "u", "/h", "FROM x", 80, ["tools"])
    cases = [
        (good, None), ((" ", *good[1:]), "app_name is required"), ((None, *good[1:]), "app_name is required"),
        (("a b", *good[1:]), "app_name must contain only letters, numbers, hyphens, and underscores"),
        ((" health ", *good[1:]), "app_name cannot be a reserved path"), (("ok", "", *good[2:]), "username is required"),
        (("ok", "u", None, *good[3:]), "user_home_directory is required"), (("ok", "u", "h", "\t", 1, []), "dockerfile is required"),
        (("ok", "u", "h", "d", 0, []), "port must be between 1 and 65535"), (("ok", "u", "h", "d", None, []), "port must be between 1 and 65535"),
        (("ok", "u", "h", "d", 65535, ["tools", "bad", "worse"]), "invalid optional feature: bad"), (("ok", "u", "h", "d", 1, None), None),
    ]
    schema = "id INT, app_name STRING, username STRING, user_home_directory STRING, dockerfile STRING, port INT, optional_features ARRAY<STRING>"
    apps = spark.createDataFrame([(i, *row) for i, (row, _) in enumerate(cases)], schema)
    assert [p for _, p in rows(r.check_rows(apps, ["tools"]), "id", "problem")] == [p for _, p in sorted(enumerate(p for _, p in cases), key=repr)]
    assert sum(n for _, n in rows(r.count_problems(apps, ["tools"]))) == len(cases)


def test_runs(spark):
    spark.range(1200).createOrReplaceTempView("numbers")
    fine = g.run_query(spark, "SELECT * FROM numbers WHERE id >= :low", args={"low": 100})
    log = fine.log(spark).first()
    assert log.checked and log.estimated_bytes > 0
    assert (fine.frame.count(), log.row_count, log.is_large, log.success, log.attempt) == (1100, 1100, True, True, 1)
    asked = []

    def repair(sql, error):
        asked.append(error)
        return "SELECT nosuch FROM numbers"

    failed = g.run_query(spark, "SELEC 1", "bad", repair, max_retries=2)
    assert failed.frame is None and [x[1] for x in failed.records] == [1, 2, 3] and len(asked) == 2
    assert failed.log(spark).where("success OR is_large").count() == 0
    gave_up = g.run_query(spark, "SELEC 1", repair=lambda sql, error: None)
    assert len(gave_up.records) == 1
    summary = g.attempt_summary(failed.log(spark)).first()
    assert (summary.attempts, summary.success, summary.final_sql) == (3, False, "SELECT nosuch FROM numbers") and "nosuch" in summary.last_error


def test_all_attempts_count(spark):
    attempts = spark.createDataFrame([("q", i, f"s{i}", i == 5, None if i == 5 else "e") for i in range(1, 6)], "query_id STRING, attempt INT, sql STRING, success BOOLEAN, error STRING")
    got = g.attempt_summary(attempts).first()
    assert (got.attempts, got.success, got.final_sql) == (5, True, "s5")


def test_a_run_is_one_job_and_is_observed(spark, tmp_path):
    """The caller's write is the run: one job, with the rows and bytes of what was written."""
    rows = [(1, "ab", None, [1, 2]), (2, None, 1.5, None), (3, "ünï", 2.5, [])]
    df = spark.createDataFrame(rows, "id LONG, name STRING, x DOUBLE, xs ARRAY<INT>").coalesce(1)
    context, out = spark.sparkContext, str(tmp_path / "out")
    context.setJobGroup("one-run", "a run")
    run = g.run_query(spark, "SELECT * FROM {d}", args={"d": df}, write=lambda frame: frame.write.parquet(out))
    jobs = context.statusTracker().getJobIdsForGroup("one-run")
    context.setLocalProperty("spark.jobGroup.id", None)
    log = run.log(spark).first()
    assert len(jobs) == 1 and spark.read.parquet(out).count() == 3
    assert (log.row_count, log.result_bytes, log.success) == (3, 3 * 8 + 2 + 5 + 2 * 8 + len("[1,2]") + len("[]"), True)
    empty = g.run_query(spark, "SELECT * FROM {d} WHERE false", args={"d": df}).log(spark).first()
    assert (empty.row_count, empty.result_bytes, empty.is_large) == (0, 0, False)
