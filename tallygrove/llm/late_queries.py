"""Registered queries of the manifest, the resampling and the license scan, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, merkle, resampling
from .common import table
from .queries import query
from .signatures import BASE, CONFIDENCE, RULES

_DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

#: CRC of a list of bytes' halves, lower one first, in SQL; ``t`` is the table of 16 entries.
_NIBBLES_SQL = """nibbles AS (SELECT list(list_reduce([x, 0, 0, 0, 0], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t
        FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS x))"""


def _crc_sql(halves: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {halves}), lambda c, d: xor(t[(xor(c, d) & 15) + 1], c >> 4)), 4294967295)"


@query(
    "op11_merkle",
    f"""
    WITH RECURSIVE fields AS (
        SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
        FROM documents),
    {_NIBBLES_SQL},
    copies AS (
        SELECT f.*, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN {_crc_sql("flatten([[ord(c) & 15, ord(c) >> 4] for c in string_split(CAST(doc_id AS VARCHAR), '')])")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
        FROM fields f, nibbles),
    leaves AS (SELECT *, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claim FROM copies),
    tree AS (
        SELECT source, 0 AS l, p, n, leaf AS h FROM leaves
        UNION ALL SELECT source, l + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY source, l, p // 3, n),
    tops AS (SELECT source, l AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1),
    above AS (
        SELECT 0 AS l, p, n, subroot AS h FROM tops
        UNION ALL SELECT l + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM above WHERE n > 1 GROUP BY l, p // 3, n),
    nodes AS (SELECT true AS inner_tree, source, l, p, h FROM tree WHERE n > 1 UNION ALL SELECT false, NULL, l, p, h FROM above WHERE n > 1),
    runs AS (SELECT inner_tree, source, l, p // 3 AS run, list(h ORDER BY p) AS hs FROM nodes GROUP BY ALL),
    walk AS (
        SELECT doc_id, leaf, s.source, s.depth, s.subroot, s.p AS tp, 0 AS l, CASE WHEN s.depth = 0 THEN s.p ELSE v.p END AS p, claim AS h, '' AS proof
        FROM leaves v JOIN tops s ON v.source IS NOT DISTINCT FROM s.source
        UNION ALL
        SELECT doc_id, leaf, w.source, depth, subroot, tp, w.l + 1, CASE WHEN w.l + 1 = depth THEN tp ELSE p // 3 END,
            sha256(array_to_string(hs[:CAST(p % 3 AS BIGINT)] || [w.h] || hs[CAST(p % 3 AS BIGINT) + 2:], '')),
            proof || array_to_string(hs[:CAST(p % 3 AS BIGINT)] || hs[CAST(p % 3 AS BIGINT) + 2:], '')
        FROM walk w JOIN runs r ON r.inner_tree = (w.l < depth) AND (NOT r.inner_tree OR r.source IS NOT DISTINCT FROM w.source)
            AND r.l = CASE WHEN w.l < depth THEN w.l ELSE w.l - depth END AND r.run = p // 3)
    SELECT doc_id, leaf, subroot, a.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = a.h AS verified
    FROM walk w, above a WHERE a.n = 1 AND w.l = depth + a.l
    """,
)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *_DOCUMENT)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, copy={"text": text}).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(
    "op12_resampling",
    f"""
    WITH {_NIBBLES_SQL},
    every AS (SELECT true AS ours, doc_id AS id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
    texts AS (
        SELECT ours, id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM every),
    found AS (
        SELECT ours, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM texts),
    distinct_features AS (SELECT DISTINCT f, string_split(lower(hex(encode(f))), '') AS h FROM found),
    hashed AS (
        SELECT f, {_crc_sql("flatten(list_transform(range(1, len(h), 2), lambda i: [instr('0123456789abcdef', h[i + 1]) - 1, instr('0123456789abcdef', h[i]) - 1]))")} % 10000 AS bucket
        FROM distinct_features, nibbles),
    placed AS (SELECT ours, r, bucket FROM found JOIN hashed USING (f)),
    counts AS (SELECT bucket, CAST(count(*) FILTER (ours) AS DOUBLE) AS s, CAST(count(*) FILTER (NOT ours) AS DOUBLE) AS t FROM placed GROUP BY bucket),
    totals AS (SELECT sum(s) AS cs, sum(t) AS ct FROM counts),
    gains AS (SELECT bucket, CAST(floor(1000.0 * ln((t + 1.0) * (cs + 10000.0) / ((s + 1.0) * (ct + 10000.0)))) AS BIGINT) AS gain FROM counts, totals),
    sums AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM placed JOIN gains USING (bucket) WHERE ours GROUP BY r),
    weights AS (
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(g // n - CAST(g % n < 0 AS BIGINT), 0) AS weight,
            CAST('0x' || substring(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
        FROM texts LEFT JOIN sums USING (r) WHERE ours),
    scored AS (SELECT *, weight + CAST(floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM weights),
    ordered AS (
        SELECT *, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * (SELECT count(*) FROM ordered WHERE fit) // 100 THEN place END AS rank FROM ordered
    """,
)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES_SQL = ", ".join(
    f"({i}, {_quoted(r.label)}, {r.priority}, {_quoted(f' {r.keyword} ' if r.keyword else '')}, {_quoted(licenses.spaced(r.pattern))})" for i, r in enumerate(RULES))
_BASE_SQL = ", ".join(f"({-1 - i}, {_quoted(label)}, 0, '', {_quoted(licenses.spaced(phrase))})" for i, (label, phrase) in enumerate(BASE))
_SURE_SQL = "CASE priority " + " ".join(f"WHEN {p} THEN {c}" for p, c in {0: CONFIDENCE[1], **CONFIDENCE}.items()) + " END"


@query(
    "op13_license_scan",
    f"""
    WITH rules(rule, label, priority, keyword, pattern) AS (VALUES {_RULES_SQL}, {_BASE_SQL}),
    docs AS (
        SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
    plain AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS t FROM docs),
    met AS (
        SELECT r, rule, string_split(trim(regexp_replace(t, pattern, ' ' || chr(1) || ' \\0 ' || chr(2) || ' ', 'g'), ' '), '  ') AS w
        FROM plain JOIN rules ON contains(t, keyword) WHERE regexp_matches(t, pattern)),
    marks AS (SELECT r, rule, unnest(range(len(w))) AS i, unnest(w) AS x FROM met),
    starts AS (SELECT r, rule, i, row_number() OVER (PARTITION BY r, rule ORDER BY i) AS k FROM marks WHERE x = chr(1)),
    ends AS (SELECT r, rule, i, row_number() OVER (PARTITION BY r, rule ORDER BY i) AS k FROM marks WHERE x = chr(2)),
    found AS (
        SELECT s.r, s.rule, label, priority, s.i - 2 * (s.k - 1) AS a, e.i - 2 * s.k + 1 AS b
        FROM starts s JOIN ends e USING (r, rule, k) JOIN rules USING (rule)),
    kept AS (
        SELECT * FROM found d WHERE priority = 0 OR NOT EXISTS (
            SELECT 1 FROM found e WHERE e.r = d.r AND e.a <= d.a AND e.b >= d.b AND e.priority > 0
                AND (e.priority > d.priority OR e.priority = d.priority AND (e.b - e.a > d.b - d.a OR e.rule < d.rule)))),
    figures AS (
        SELECT r, count(*) FILTER (priority = 0) AS n_base, min(a) FILTER (priority = 0) AS first_word, max(a) FILTER (priority = 0) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (priority = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
            CAST(max({_SURE_SQL}) AS DOUBLE) AS score FROM kept GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM docs LEFT JOIN figures USING (r)
    """,
)
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
