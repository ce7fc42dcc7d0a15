import datetime as dt
import json

from pyspark.sql import functions as F

from tallygrove.session import ensure_checkpoint_dir, scratch_path
from tallygrove.sources import files as s
from tallygrove.sources import tables as st
from tallygrove.streaming import activity as a
from tallygrove.streaming import logs as g


def test_csv(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, ' a "q", b\nline ', None), (2, "", 1.5)], "id INT, text STRING, v DOUBLE")
    path = str(tmp_path / "out")
    s.write_csv(df.coalesce(1), path)
    # An empty text and a missing one look alike in CSV and come back as missing.
    assert rows(s.read_csv(spark, path, df.schema, multi_line=True)) == [(1, ' a "q", b\nline ', None), (2, None, 1.5)]
    assert s.read_csv(spark, path).dtypes == [("id", "string"), ("text", "string"), ("v", "string")]
    assert s.read_csv(spark, path, infer=True, multi_line=True).dtypes[0] == ("id", "int")
    listed = s.list_files(spark, str(tmp_path), "*.csv")
    assert listed.columns == ["path", "size_bytes", "modificationTime"] and listed.count() == 1
    assert s.list_files(spark, str(tmp_path), "*.txt").count() == 0


def test_tables(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS ward")
    spark.sql("CREATE TABLE IF NOT EXISTS ward.person (person_id BIGINT COMMENT 'key', name STRING) USING parquet")
    spark.sql("INSERT OVERWRITE ward.person VALUES (1, 'a'), (2, 'b')")
    assert st.read_table(spark, "ward.person").count() == 2
    assert rows(st.table_columns(spark, "ward.person"), "position", "column_name", "data_type", "description") == [
        (1, "person_id", "bigint", "key"), (2, "name", "string", None),
    ]
    assert st.table_columns(spark, "`spark_catalog`.`ward`.`person`").count() == 2
    assert st.table_columns(spark, "person") is None and st.table_columns(spark, "ward.none") is None and st.table_columns(spark, "a.b.c.d") is None
    found = st.list_tables(spark, ["nosuch", "spark_catalog"]).where("dataset = 'ward'")
    assert rows(found, "priority", "project", "table_name") == [(1, "spark_catalog", "person")]
    spark.sql("ANALYZE TABLE ward.person COMPUTE STATISTICS")
    assert st.dataset_tables(spark, "ward").first().row_count == 2
    tables = st.dataset_tables(spark, "ward", count_rows=True).first()
    assert (tables.table_name, tables.row_count, tables.table_type) == ("person", 2, "MANAGED") and tables.size_bytes > 0
    assert st.dataset_tables(spark, "a.b.c") is None and st.dataset_tables(spark, "nosuch") is None
    asked = st.sql_with(spark, "SELECT count(*) AS n FROM IDENTIFIER(:t) JOIN {members} USING (person_id)", t="ward.person", members=spark.createDataFrame([(1,)], "person_id BIGINT"))
    assert rows(asked) == [(1,)]


def test_shared_folder(spark):
    ensure_checkpoint_dir(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(named) and scratch_path(spark, "x") != scratch_path(spark, "x")
    assert named in spark.sparkContext.getCheckpointDir()


def test_log_stream(spark, tmp_path, rows):
    logs = tmp_path / "logs" / "c1"
    logs.mkdir(parents=True)
    lines = [json.dumps({"log": "hello", "stream": "stdout", "time": "2024-03-29T16:15:58Z"}), "not json", "x" * 500]
    (logs / "c1.log").write_text("\n".join(lines) + "\n")
    (logs / "skip.txt").write_text("no\n")
    parsed = g.parse_container_lines(g.tail_files(spark, str(tmp_path / "logs"), max_length=200))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    g.write_routed(parsed, out, marks, available_now=True).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got, "log", "stream", "tag") == [("hello", "stdout", "vm-docker-logs"), (None, None, "vm-docker-logs")]
    assert all(r.filepath.endswith("c1.log") for r in got.collect())
    (logs / "c2.log").write_text(lines[0] + "\n")
    g.write_routed(parsed, out, marks, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_units(spark, rows):
    df = spark.createDataFrame([("docker.service",), ("devcontainer.service",), ("cron.service",), (None,)], "unit STRING")
    assert rows(g.routed(g.keep_units(df))) == [("devcontainer.service", "vm-journald-startup-logs"), ("docker.service", "vm-journald-logs")]
    assert g.routed(df.withColumn("tag", F.lit("other-logs"))).count() == 0


def test_activity_stream_matches_batch(spark, tmp_path, rows):
    start = dt.datetime(2024, 1, 1)
    data = [("hot" if i % 3 == 0 else f"m{i % 7}", ["cpu", "proxy", "ssh", "boot", "other"][i % 5], start + dt.timedelta(minutes=(i * 37) % 400)) for i in range(300)]
    marks = spark.createDataFrame(data, "machine STRING, kind STRING, at TIMESTAMP")
    source = str(tmp_path / "marks")
    marks.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, place = str(tmp_path / "activity"), str(tmp_path / "place")
    a.write_last_activity(stream, out, place, available_now=True).awaitTermination()
    saved = spark.read.parquet(out)
    assert saved.select("batch").distinct().count() == 3
    assert rows(a.merge_activity(saved)) == rows(a.last_activity(marks))


def test_idle(spark, rows):
    at = dt.datetime(2024, 1, 1, 12)
    cases = [("a", 600, 601), ("b", 600, 600), ("c", 0, 9999), ("d", None, 9999)]
    df = spark.createDataFrame([(m, t, at - dt.timedelta(seconds=s)) for m, t, s in cases], "machine STRING, timeout INT, last_active TIMESTAMP")
    got = a.idle_machines(df, F.lit("2024-01-01 12:00:00").cast("timestamp"), F.col("timeout"))
    assert rows(got, "machine", "is_idle") == [("a", True), ("b", False), ("c", False), ("d", False)]
    assert a.idle_machines(df, F.current_timestamp(), None).where("is_idle").count() == 0


def test_marks(spark, rows):
    lines = spark.createDataFrame([("m", "2024/03/29 16:15:58 Forwarded request to backend"), ("m", "2024/03/29 17:00:00 other"), ("m", "bad Forwarded request to backend")], "machine STRING, line STRING")
    assert rows(a.proxy_marks(lines)) == [("m", "proxy", dt.datetime(2024, 3, 29, 16, 15, 58))]
    loads = spark.createDataFrame([("m", 0.1, 1), ("m", 0.09, 2)], "machine STRING, load DOUBLE, at INT")
    assert rows(a.load_marks(loads)) == [("m", "cpu", 1)]


def test_activity_batches_are_compacted(spark, tmp_path, rows):
    source, out = tmp_path / "marks", str(tmp_path / "out")
    source.mkdir()
    schema = "machine STRING, kind STRING, at TIMESTAMP"
    data = [(f"m{i % 3}", "cpu", dt.datetime(2024, 1, 1, i)) for i in range(7)]
    for i, row in enumerate(data):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    a.write_last_activity(stream, out, str(tmp_path / "place"), available_now=True, compact_every=3).awaitTermination()
    saved = spark.read.parquet(out).drop("batch")
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 2  # batches 5 and 6
    assert rows(a.merge_activity(saved)) == rows(a.last_activity(spark.createDataFrame(data, schema)))
