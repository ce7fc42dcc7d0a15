"""Registered queries of the subpackage, each with its SQL counterpart where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, linededup, mixing, neighbours, quality, quotes, sharding, simhash, suffixes, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("probability", 6).alias("probability"),
    )


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, radius=3)


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"), 40)


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


@query(
    "op6_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS s FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS low FROM p)
    SELECT page_id, n AS payload_bytes, s AS payload_digest,
        CASE WHEN n >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND page_id <> low THEN low END AS refers_to
    FROM f
    """,
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = warc.new_folder(pages)
    return warc.read(warc.write(pages, folder), folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op9_nearest",
    """
    WITH v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0, 20)


@query(
    "op2_line_dedup",
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    w AS (SELECT doc_id, i, ls[i] AS x, ls[i + 1] AS y, ls[i + 2] AS z FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
    n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS k FROM w
          WHERE NOT regexp_full_match(x || y || z, '[\x20\x09-\x0D]*')),
    c AS (SELECT DISTINCT doc_id, i + j AS i FROM n, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
    e AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
    k AS (SELECT e.doc_id, count(*) AS n_lines, count(c.i) AS n_removed, string_agg(line, chr(10) ORDER BY e.i) FILTER (WHERE c.i IS NULL) AS kept
          FROM e LEFT JOIN c USING (doc_id, i) GROUP BY e.doc_id)
    SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
        CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS text
    FROM documents d LEFT JOIN k USING (doc_id)
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "row.doc_id", "n_lines", F.size("removed").alias("n_removed"), F.col("kept_text").alias("text")
    )


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail: every turn quotes the one before, which quotes the one before that.

    Of a turn that is there more than once, the first text by code points is quoted.
    """
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.coalesce("text", F.lit(""))
    own = turns.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min(said).alias("said"))

    def back(n: int, name: str) -> DataFrame:
        return own.select(F.col("c").alias(f"c{n}"), (F.col("t") + n).alias(f"t{n}"), F.col("said").alias(name))

    def quoted(name: str, marks: str):
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(marks), F.replace(F.col(name), F.lit("\n"), F.lit("\n" + marks))))

    met = turns
    for n, name in ((1, "last"), (2, "before")):
        other = back(n, name)
        met = met.join(other, (F.col("conv_id") == F.col(f"c{n}")) & (F.col("turn") == F.col(f"t{n}")), "left")
    body = F.concat_ws("\n\n", quoted("before", "> > "), quoted("last", "> "), F.coalesce("text", F.lit("")))
    return met.select("conv_id", "turn", "role", body.alias("text"))


_SPACES_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(
    "op8_quote_threads",
    f"""
    WITH RECURSIVE own AS (SELECT conv_id, turn, min(coalesce(text, '')) AS said FROM conversations GROUP BY conv_id, turn),
    mail AS (
        SELECT c.conv_id, c.turn, concat_ws(chr(10) || chr(10),
            '> > ' || replace(b.said, chr(10), chr(10) || '> > '), '> ' || replace(a.said, chr(10), chr(10) || '> '), coalesce(c.text, '')) AS body
        FROM conversations c LEFT JOIN own a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
        LEFT JOIN own b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
    split AS (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM mail),
    marked AS (SELECT *, regexp_extract(line, '^([ \t]*>)+') AS marks FROM split),
    parsed AS (
        SELECT conv_id, turn, i, line, len(replace(replace(marks, ' ', ''), chr(9), '')) AS level,
            lower(regexp_replace(trim(substring(line, len(marks) + 1), {_SPACES_SQL}), '[\x20\x09-\x0D]+', ' ', 'g')) AS words
        FROM marked),
    begun AS (
        SELECT *, words <> '' AND (lag(level) OVER w IS DISTINCT FROM level OR lag(words) OVER w = '') AS starts
        FROM parsed WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
    numbered AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM begun),
    passages AS (
        SELECT conv_id, turn, level, string_agg(words, ' ' ORDER BY i) AS passage FROM numbered WHERE words <> '' GROUP BY conv_id, turn, k, level),
    wrote AS (SELECT passage, conv_id, min(turn) AS turn FROM passages WHERE level = 0 GROUP BY passage, conv_id),
    anyone AS (SELECT passage, min({{'c': conv_id, 't': turn}}) AS far FROM wrote GROUP BY passage),
    quoted AS (SELECT conv_id, turn, passage, min(level) AS level, count(*) * len(passage) AS n FROM passages WHERE level > 0 GROUP BY conv_id, turn, passage),
    known AS (
        SELECT q.conv_id, q.turn, level, n, CASE WHEN w.turn < q.turn THEN {{'c': w.conv_id, 't': w.turn}}
            WHEN far.c < q.conv_id OR far.c = q.conv_id AND far.t < q.turn THEN far END AS parent
        FROM quoted q LEFT JOIN wrote w ON w.passage = q.passage AND w.conv_id = q.conv_id LEFT JOIN anyone y ON y.passage = q.passage),
    summed AS (SELECT conv_id, turn, level, parent, sum(n) AS n FROM known WHERE parent IS NOT NULL GROUP BY ALL),
    best AS (SELECT conv_id, turn, parent FROM summed QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent) = 1),
    links AS (SELECT m.conv_id, m.turn, parent FROM mail m LEFT JOIN best USING (conv_id, turn)),
    walk AS (
        SELECT conv_id, turn, parent, conv_id AS root_c, turn AS root_t, 0 AS depth, [{{'c': conv_id, 't': turn}}] AS way FROM links WHERE parent IS NULL
        UNION ALL SELECT l.conv_id, l.turn, l.parent, root_c, root_t, depth + 1, list_append(way, {{'c': l.conv_id, 't': l.turn}}) FROM links l JOIN walk ON l.parent.c = walk.conv_id AND l.parent.t = walk.turn),
    texts AS (
        SELECT conv_id, turn, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), {_SPACES_SQL}), '') AS text FROM parsed GROUP BY conv_id, turn),
    quotes AS (SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n_quotes FROM passages WHERE level > 0 GROUP BY conv_id, turn)
    SELECT conv_id, turn, parent.c AS parent_conv_id, parent.t AS parent_turn, root_c AS root_conv_id, root_t AS root_turn, depth,
        dense_rank() OVER (PARTITION BY root_c, root_t ORDER BY way) - 1 AS place,
        coalesce(n_quotes, 0) AS n_quotes, text
    FROM walk JOIN texts USING (conv_id, turn) LEFT JOIN quotes USING (conv_id, turn)
    """,
)
def op8_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(mailbox(spark, sf_dir), ["conv_id", "turn"], ["conv_id"]).select(
        "id.conv_id", "id.turn", F.col("parent.conv_id").alias("parent_conv_id"), F.col("parent.turn").alias("parent_turn"),
        F.col("root.conv_id").alias("root_conv_id"), F.col("root.turn").alias("root_turn"), "depth", "place", "n_quotes", F.col("own").alias("text"),
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES["pipeline"] = corpus_pipeline.run

from . import late_queries  # noqa: E402, F401
