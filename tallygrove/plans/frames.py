"""Frame joins, previews, listings, registry rules, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as n
from ..operators import frames as f
from ..operators import registry as r
from ..operators import runlog as g
from ..operators.joins import join_common
from ..session import scratch_path
from . import query
from .bind import as_text, table


@query(
    "natural_join_nullsafe",
    """WITH a AS (SELECT doc_id, nullif(source, 'src1') AS source, quality FROM labels JOIN documents USING (doc_id)),
            b AS (SELECT doc_id, nullif(source, 'src1') AS source, lang, n_chars FROM documents)
       SELECT a.doc_id, a.source, quality, lang, n_chars FROM a JOIN b
         ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.source IS NOT DISTINCT FROM b.source""",
)
def natural_join_nullsafe(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumn("source", F.nullif("source", F.lit("src1")))
    labels = table(spark, sf_dir, "labels").join(documents, "doc_id").select("doc_id", "source", "quality")
    return join_common(labels, documents.select("doc_id", "source", "lang", "n_chars"))


@query(
    "lists_to_text",
    """SELECT doc_id, '[' || array_to_string(list_transform(string_split(source || '-' || lang, '-'), lambda x: '"' || x || '"'), ',') || ']' AS parts
       FROM documents""",
)
def lists_to_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return f.lists_to_text(documents.select("doc_id", F.split(F.concat_ws("-", "source", "lang"), "-").alias("parts")))


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS text, lang, source, n_chars
       FROM documents ORDER BY doc_id LIMIT 100""",
)
def preview(spark, sf_dir):
    return f.preview(table(spark, sf_dir, "documents"), order=["doc_id"])


@query(
    "preview_note",
    """SELECT count(*) AS total_rows, CASE WHEN count(*) = 0 THEN '(No results)' WHEN count(*) > 100
         THEN '... showing 100 of ' || CAST(count(*) AS VARCHAR) || ' rows' ELSE '' END AS note FROM documents""",
)
def preview_note(spark, sf_dir):
    return f.preview_note(table(spark, sf_dir, "documents"))


@query(
    "limit_explore",
    "SELECT count(*) AS shown FROM (SELECT * FROM orders LIMIT 100) AS q",
)
def limit_explore(spark, sf_dir):
    """Rows left by the limit of the exploring mode, which is what the mode is for."""
    return n.limit_for(table(spark, sf_dir, "orders"), "explore").agg(F.count(F.lit(1)).alias("shown"))


@query(
    "last_lines",
    """SELECT user_id, event_id, event_type, line_rank FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS line_rank FROM events) AS q
       WHERE line_rank <= 5""",
)
def last_lines(spark, sf_dir):
    lines = f.last_lines(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5)
    return lines.select("user_id", "event_id", "event_type", "line_rank")


@query(
    "last_lines_many",
    """SELECT event_type, event_id, line_rank FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS line_rank FROM events) AS q
       WHERE line_rank <= 1500""",
)
def last_lines_many(spark, sf_dir):
    lines = f.last_lines(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 1500)
    return lines.select("event_type", "event_id", "line_rank")


@query(
    "newest_first",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC",
)
def newest_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("created_at"))
    return as_text(f.newest_first(orders, tie="o_orderkey"), "created_at")


@query("row_total", "SELECT count(*) AS total FROM orders")
def row_total(spark, sf_dir):
    return f.row_total(table(spark, sf_dir, "orders"))


@query(
    "status_join",
    """SELECT c_custkey, c_name, coalesce(CASE WHEN latest = 'F' THEN 'exited' WHEN latest = 'O' THEN 'running' WHEN latest = 'P' THEN 'paused' END,
              'not_found') AS status
       FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS latest FROM orders
                                GROUP BY o_custkey) AS s ON o_custkey = c_custkey""",
)
def status_join(spark, sf_dir):
    words = {"F": "exited", "O": "running", "P": "paused"}
    table_of_words = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    states = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(table_of_words[F.max_by("o_orderstatus", "o_orderkey")].alias("status"))
    )
    registry = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("unknown").alias("status"))
    return f.with_status(registry, states, "c_custkey")


_APPS_SQL = """apps AS (
  SELECT p_partkey AS id,
         CASE p_size % 7 WHEN 0 THEN '   ' WHEN 1 THEN p_name WHEN 2 THEN ' health ' ELSE replace(p_name, ' ', '_') END AS app_name,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS username,
         CASE WHEN p_size % 11 = 0 THEN NULL ELSE '/home/' || p_brand END AS user_home_directory,
         CASE WHEN p_size % 13 = 0 THEN chr(10) ELSE p_type END AS dockerfile,
         CASE WHEN p_size % 8 = 0 THEN 70000 ELSE p_size - 3 END AS port,
         CASE WHEN p_size % 3 = 0 THEN ['tools', lower(p_type)] ELSE ['tools'] END AS features FROM part),
checked AS (
  SELECT id, CASE
    WHEN trim(app_name) = '' THEN 'app_name is required'
    WHEN NOT regexp_full_match(trim(app_name), '[a-zA-Z0-9_-]+') THEN 'app_name must contain only letters, numbers, hyphens, and underscores'
    WHEN trim(app_name) IN ('_app', 'health') THEN 'app_name cannot be a reserved path'
    WHEN username = '' THEN 'username is required'
    WHEN user_home_directory IS NULL THEN 'user_home_directory is required'
    WHEN dockerfile = chr(10) THEN 'dockerfile is required'
    WHEN port NOT BETWEEN 1 AND 65535 THEN 'port must be between 1 and 65535'
    WHEN len(features) > 1 AND features[2] <> 'small' THEN 'invalid optional feature: ' || features[2] END AS problem
  FROM apps)"""


def _apps(spark, sf_dir):
    size = F.col("p_size")
    kind = size % 7
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(kind == 0, "   ").when(kind == 1, F.col("p_name")).when(kind == 2, " health ")
        .otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("app_name"),
        F.when(size % 5 == 0, "").otherwise(F.col("p_brand")).alias("username"),
        F.when(size % 11 != 0, F.concat(F.lit("/home/"), "p_brand")).alias("user_home_directory"),
        F.when(size % 13 == 0, "\n").otherwise(F.col("p_type")).alias("dockerfile"),
        F.when(size % 8 == 0, 70000).otherwise(size - 3).alias("port"),
        F.when(size % 3 == 0, F.array(F.lit("tools"), F.lower("p_type"))).otherwise(F.array(F.lit("tools"))).alias("optional_features"),
    )


@query("row_rules", f"WITH {_APPS_SQL} SELECT id, problem FROM checked")
def row_rules(spark, sf_dir):
    return r.check_rows(_apps(spark, sf_dir), ["tools", "small"]).select("id", "problem")


@query("row_rule_counts", f"WITH {_APPS_SQL} SELECT problem, count(*) AS n FROM checked GROUP BY problem")
def row_rule_counts(spark, sf_dir):
    return r.count_problems(_apps(spark, sf_dir), ["tools", "small"])


_ATTEMPTS_SQL = """attempts AS (
  SELECT 'q' || CAST(l_orderkey AS VARCHAR) AS query_id, l_linenumber AS attempt,
         'select ' || CAST(l_linenumber AS VARCHAR) AS sql, max(l_quantity) > 40 AS success,
         CASE WHEN max(l_quantity) > 40 THEN NULL
              ELSE '400 POST line ' || CAST(l_linenumber AS VARCHAR) || ': 404 not found ' END AS error
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _attempts(spark, sf_dir):
    """One attempt per order and line number; orders play the queries."""
    line = F.col("attempt").cast("string")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("attempt")).agg(
        (F.max("l_quantity") > 40).alias("success")
    )
    return grouped.select(
        F.concat(F.lit("q"), "l_orderkey").alias("query_id"),
        "attempt",
        F.concat(F.lit("select "), line).alias("sql"),
        "success",
        F.when(~F.col("success"), F.concat(F.lit("400 POST line "), line, F.lit(": 404 not found "))).alias("error"),
    )


@query(
    "run_log",
    f"""WITH {_ATTEMPTS_SQL}
        SELECT query_id, max(attempt) AS attempts, arg_max(success, attempt) AS success, arg_max(sql, attempt) AS final_sql,
               'POST line ' || CAST(min(attempt) FILTER (NOT success) AS VARCHAR) || ': 404 not found' AS first_error,
               'POST line ' || CAST(max(attempt) FILTER (NOT success) AS VARCHAR) || ': 404 not found' AS last_error
        FROM attempts GROUP BY query_id""",
)
def run_log(spark, sf_dir):
    return g.attempt_summary(_attempts(spark, sf_dir))


@query(
    "run_sizes",
    """SELECT o_orderpriority AS query_id, count(*) AS row_count, count(*) > 1000 AS is_large,
              round(sum(o_orderkey * 100) / 1048576.0, 2) AS megabytes FROM orders GROUP BY o_orderpriority""",
)
def run_sizes(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("query_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("o_orderkey") * 100).alias("bytes")
    )
    return g.with_megabytes(g.with_large_flag(runs)).drop("bytes")


@query(
    "query_runs",
    """SELECT 'orders_by_person' AS query_id, 1 AS attempt, true AS checked, true AS has_estimate, true AS success, count(DISTINCT o_custkey) AS row_count,
              count(DISTINCT o_custkey) > 1000 AS is_large FROM orders
       UNION ALL SELECT 'repaired', 1, false, false, false, NULL, false
       UNION ALL SELECT 'repaired', 2, true, true, true, count(*), count(*) > 1000 FROM customer""",
)
def query_runs(spark, sf_dir):
    """Two statements over whole tables; the second is repaired once by the caller's function."""
    frames = {"orders": table(spark, sf_dir, "orders"), "customers": table(spark, sf_dir, "customer")}
    first = g.run_query(spark, "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey", "orders_by_person", args=frames)
    second = g.run_query(
        spark, "SELECT c_nosuch FROM {customers}", "repaired", repair=lambda sql, error: "SELECT c_custkey FROM {customers}", args=frames
    )
    log = first.log(spark).unionByName(second.log(spark))
    return log.withColumn("has_estimate", F.coalesce(F.col("estimated_bytes") > 0, F.lit(False))).drop("sql", "error", "estimated_bytes", "result_bytes")


@query(
    "written_run",
    """SELECT 'segments' AS query_id, 1 AS attempt, true AS success, count(*) AS row_count, sum(8 + strlen(c_mktsegment) + 8) AS result_bytes,
              count(*) > 1000 AS is_large, count(*) AS rows_read FROM customer""",
)
def written_run(spark, sf_dir):
    """A statement run once: written by the caller, its rows and bytes observed on the way."""
    path = scratch_path(spark, "written-run")
    run = g.run_query(
        spark, "SELECT c_custkey, c_mktsegment, c_acctbal FROM {customers}", "segments", args={"customers": table(spark, sf_dir, "customer")},
        write=lambda frame: frame.write.mode("overwrite").parquet(path),
    )
    read = spark.read.schema(run.frame.schema).parquet(path).groupBy(F.lit("segments").alias("query_id")).agg(F.count(F.lit(1)).alias("rows_read"))
    return run.log(spark).join(read, "query_id").select("query_id", "attempt", "success", "row_count", "result_bytes", "is_large", "rows_read")
