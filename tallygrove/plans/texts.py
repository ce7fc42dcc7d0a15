"""SQL blocks, pipe tables, error texts, message parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import texts as o
from . import query
from .bind import table

_STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_ANSWERS_SQL = """answers AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Here: ```sql' || chr(10) || text || chr(10) || '``` done'
           WHEN turn % 3 = 0 THEN '``` ' || chr(10) || CASE WHEN length(text) % 2 = 0 THEN 'with x ' ELSE '' END || text || '```'
           ELSE text END AS answer FROM conversations)"""


def _answers(spark, sf_dir):
    turn, text = F.col("turn"), F.col("text")
    word = F.when(F.length(text) % 2 == 0, "with x ").otherwise("")
    answer = (
        F.when(turn % 2 == 0, F.concat(F.lit("Here: ```sql\n"), text, F.lit("\n``` done")))
        .when(turn % 3 == 0, F.concat(F.lit("``` \n"), word, text, F.lit("```")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


@query(
    "sql_blocks",
    f"""WITH {_ANSWERS_SQL}, cut AS (
          SELECT conv_id, turn, answer, {_STRIP.format("regexp_extract(answer, '```sql\\s*\\n(.*?)```', 1, 's')")} AS marked,
                 {_STRIP.format("regexp_extract(answer, '```\\s*\\n(.*?)```', 1, 's')")} AS plain FROM answers)
        SELECT conv_id, turn, CASE WHEN regexp_matches(answer, '```sql\\s*\\n(.*?)```', 's') THEN marked
          WHEN regexp_matches(answer, '```\\s*\\n(.*?)```', 's') AND regexp_matches(upper(plain), 'SELECT|WITH|INSERT|CREATE') THEN plain END AS sql
        FROM cut""",
)
def sql_blocks(spark, sf_dir):
    return o.extract_sql(_answers(spark, sf_dir), "answer").drop("answer")


@query(
    "marked_sql",
    f"""WITH {_ANSWERS_SQL} SELECT conv_id, turn, {_STRIP.format("regexp_extract(answer, '```sql\\s*\\n(.*?)```', 1, 's')")} AS sql FROM answers""",
)
def marked_sql(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", t.marked_sql(F.col("answer")).alias("sql"))


@query(
    "pipe_rows",
    """WITH lines AS (
         SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS ls FROM documents
         WHERE contains(text, '|')),
       tagged AS (
         SELECT doc_id, ls, list_transform(ls, lambda x: contains(x, '|') AND NOT regexp_full_match(x, '[\\s|+-]+')) AS is_row FROM lines),
       bounded AS (
         SELECT doc_id, ls, is_row, list_position(is_row, true) AS first_row FROM tagged WHERE list_contains(is_row, true)),
       ended AS (
         SELECT doc_id, first_row, ls[first_row:] AS rest, is_row[first_row:] AS rest_row FROM bounded),
       body AS (
         SELECT doc_id, CASE WHEN list_contains(rest, '') THEN rest[1:list_position(rest, '') - 1] ELSE rest END AS part,
                CASE WHEN list_contains(rest, '') THEN rest_row[1:list_position(rest, '') - 1] ELSE rest_row END AS part_row FROM ended),
       cells AS (
         SELECT doc_id, list_transform(list_where(part, part_row), lambda r: list_filter(list_transform(string_split(r, '|'), lambda c: trim(c)), lambda c: c <> '')) AS rs
         FROM body),
       good AS (SELECT doc_id, rs[1] AS head, list_filter(rs[2:], lambda r: len(r) = len(rs[1])) AS data FROM cells),
       rows_ AS (SELECT doc_id, head, unnest(data) AS r, unnest(range(len(data))) AS row_no FROM good)
       SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, CAST(c AS INTEGER) AS column_no, head[c + 1] AS column_name, r[c + 1] AS value
       FROM (SELECT doc_id, head, r, row_no, unnest(range(len(head))) AS c FROM rows_) AS q""",
)
def pipe_rows(spark, sf_dir):
    return o.table_cells(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query(
    "pipe_rows_made",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem)
       SELECT l_orderkey, l_partkey, l_linenumber, 0 AS row_no, c AS column_no, CASE c WHEN 0 THEN 'part' ELSE 'flag' END AS column_name,
              CASE c WHEN 0 THEN CAST(l_partkey AS VARCHAR) ELSE l_returnflag END AS value
       FROM t, (VALUES (0), (1)) AS v(c)
       UNION ALL
       SELECT l_orderkey, l_partkey, l_linenumber, 1, c, CASE c WHEN 0 THEN 'part' ELSE 'flag' END,
              CASE c WHEN 0 THEN 'n' || CAST(l_linenumber AS VARCHAR) ELSE 'z' END
       FROM t, (VALUES (0), (1)) AS v(c) WHERE l_linenumber % 2 = 1""",
)
def pipe_rows_made(spark, sf_dir):
    """A text around a pipe table for every line: with a rule line, a row of another length, and an end by a blank line."""
    extra = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("n"), "l_linenumber", F.lit(" | z"))).otherwise("a | b | c")
    text = F.concat(
        F.lit("Result \n| part | flag |\n|------+------|\n| "), F.col("l_partkey"), F.lit(" | "), F.col("l_returnflag"),
        F.lit(" |\nnote\n"), extra, F.lit("\n\n| late | row |\n"),
    )
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.alias("text"))
    return o.table_cells(made, "text", ["l_orderkey", "l_partkey", "l_linenumber"])


@query(
    "csv_rows",
    """SELECT o_orderkey, 0 AS row_no, c AS column_no, ['key', 'note', 'price'][c + 1] AS column_name,
              CASE c WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'say "' || o_orderstatus || '", ' || o_orderpriority END AS value
       FROM orders, (VALUES (0), (1), (2)) AS v(c)""",
)
def csv_rows(spark, sf_dir):
    """CSV after the row-count line of an answer; the last field is missing in every record."""
    text = F.concat(
        F.lit("Query successful: 1 rows returned (2 MB)\n\nkey,note,price\n"), F.col("o_orderkey"), F.lit(',"say ""'),
        F.col("o_orderstatus"), F.lit('"", '), F.col("o_orderpriority"), F.lit('"\n'),
    )
    answers = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return o.table_cells(answers, "text", ["o_orderkey"])


@query(
    "clean_errors",
    f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '404  ' ELSE 'Bad 500' || chr(10) || ' ' END || text AS msg FROM documents),
             b AS (SELECT doc_id, regexp_replace(msg, '\\d{{3}}\\s+', '') AS bare FROM e)
        SELECT doc_id, {_STRIP.format("CASE WHEN length(bare) > 1000 THEN substring(bare, 1, 1000) || '... (truncated)' ELSE bare END")} AS error FROM b""",
)
def clean_errors(spark, sf_dir):
    start = F.when(F.col("doc_id") % 2 == 0, "404  ").otherwise("Bad 500\n ")
    messages = table(spark, sf_dir, "documents").select("doc_id", F.concat(start, "text").alias("msg"))
    return messages.select("doc_id", t.clean_error(F.col("msg")).alias("error"))


@query(
    "join_parts",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN role || chr(10) || text || chr(10) || '{"type":"image"}'
         ELSE role || chr(10) || text END AS message FROM conversations""",
)
def join_parts(spark, sf_dir):
    def part(kind: str, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    parts = F.array(part("text", F.col("role")), part("text", F.col("text")))
    image = F.array(part("image", F.lit(None).cast("string")))
    blocks = F.when(F.col("turn") % 4 == 3, F.concat(parts, image)).otherwise(parts)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.join_parts(blocks).alias("message"))
