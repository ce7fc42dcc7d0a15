"""Table catalogue out of description documents made from the parts table, one document per part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TYPE_NAMES
from ..functions.once import once
from ..operators import catalog as c
from ..operators.profile import column_profile
from ..session import scratch_path, stored
from ..sources import documents as d
from ..sources import tables as st
from . import query
from .bind import spread, table, tasks_of

_URL = "http://example.org/StructureDefinition/"
_CODES = [*TYPE_NAMES, "other"]
#: Documents that one task makes or chooses among; each is far longer than its part is in the file.
_DOCUMENTS_PER_TASK = 20_000


# ---- the made documents, in Spark ----

def _key(k: Column) -> Column:
    """Every fifth table is described by two documents."""
    return F.when(k % 5 == 1, k - 1).otherwise(k)


def _name(t: Column) -> Column:
    tail = F.concat(F.lit("d"), t % 7, F.lit(".T"), t)
    return F.when(t % 17 == 0, tail).when(t % 19 == 0, F.concat(F.lit("a.b.c.T"), t)).otherwise(F.concat(F.lit("study."), tail))


def _url(t: Column) -> Column:
    return F.concat(F.lit(_URL + "p"), t - t % 3)


def _element(j: Column) -> Column:
    k, size, name = F.col("k"), F.col("p_size"), F.col("p_name")
    codes = F.array(*[F.lit(x) for x in _CODES])
    label = F.when((k + j) % 5 == 0, "PHI").when((k + j) % 7 == 0, "UID")
    labels = F.when(
        label.isNotNull(),
        F.array(
            F.struct(
                F.lit("http://example.org/extension-inline-sec-label").alias("url"),
                F.struct(F.lit(_URL + "SensitivityLabels").alias("system"), label.alias("code")).alias("valueCoding"),
            )
        ),
    )
    binding = F.struct(
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Values of "), name)).alias("description"),
        F.when(k % 4 != 0, "required").alias("strength"),
    )
    mapping = F.array(
        F.struct(F.lit("other").alias("identity"), F.lit("x").alias("map")),
        F.struct(F.lit("vfig").alias("identity"), F.concat(F.lit("Patient.c"), j).alias("map")),
    )
    return F.struct(
        F.concat(F.lit("T.part.col"), j).alias("path"),
        F.when(j % 3 == 0, 0).when(j % 3 == 1, 1).alias("min"),
        F.concat(F.lit("Short "), j).alias("short"),
        F.concat(F.lit("Column "), j, F.lit(" of "), name).alias("definition"),
        F.when(j == 1, "first column").alias("comment"),
        F.when(
            (size + j) % 10 != 9, F.array(F.struct(F.get(codes, ((size + j) % 10).cast("int")).alias("code")))
        ).alias("type"),
        F.when(j % 2 == 0, binding).alias("binding"),
        F.when((k + j) % 6 == 0, mapping).alias("mapping"),
        labels.alias("extension"),
    )


def document_texts(spark, sf_dir) -> DataFrame:
    """JSON text and path of one document per part."""
    k, size = F.col("k"), F.col("p_size")
    given = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    parts = spread(given, _DOCUMENTS_PER_TASK, "p_partkey").withColumn("k", F.col("p_partkey")).withColumn("t", _key(F.col("k")))
    none = F.lit(None).cast("string")

    def extension(url: str, text: Column, canonical: Column = none, code: Column = none, sub: Column | None = None) -> Column:
        nested = F.array(F.struct(F.lit("table-name").alias("url"), sub.alias("valueString"))) if sub is not None else F.lit(None).cast(
            "array<struct<url:string,valueString:string>>"
        )
        return F.struct(
            F.lit(_URL + url).alias("url"), text.alias("valueString"), canonical.alias("valueCanonical"),
            code.alias("valueCode"), nested.alias("extension"),
        )

    naming = F.when(k % 13 != 0, F.array(extension("BigQueryTableSchemaMetadata", none, sub=_name(F.col("t")))))
    key = F.array(
        extension(
            "primary-identity", F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("KEY_"), size)), code=F.concat(F.lit("code"), size)
        )
    )
    links = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(2)), lambda j: j < k % 3),
        lambda j: extension("structural-link", none, canonical=F.concat(F.lit(_URL + "p"), (k * 7 + j) % 400)),
    )
    empty = F.array().cast("array<struct<url:string,valueString:string,valueCanonical:string,valueCode:string,extension:array<struct<url:string,valueString:string>>>>")

    def context(code: str, display: Column, amount: Column) -> Column:
        return F.struct(
            F.struct(F.lit(code).alias("code")).alias("code"),
            F.when(display.isNotNull(), F.struct(F.array(F.struct(display.alias("display"))).alias("coding"))).alias("valueCodeableConcept"),
            F.when(amount.isNotNull(), F.struct(amount.alias("value"))).alias("valueQuantity"),
        )

    nothing = F.lit(None).cast("double")
    contexts = F.array(
        context("compliance-zone", F.lit("old zone"), nothing),
        context("compliance-zone", F.concat(F.lit("zone "), size % 3), nothing),
        context("retention-policy", none, (k % 10).cast("double")),
        context("schema-stability", F.when(k % 2 == 0, "Stable"), nothing),
    )
    columns = F.transform(F.sequence(F.lit(0), (size % 4).cast("int")), _element)
    root = F.transform(
        F.array(F.lit(0)), lambda j: _element(j).withField("path", F.lit("T"))
    )
    document = F.struct(
        F.when(k % 11 == 0, "ValueSet").otherwise("StructureDefinition").alias("resourceType"),
        F.concat(F.lit("doc-"), k).alias("id"),
        _url(F.col("t")).alias("url"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
        F.when(k % 4 != 0, F.concat(F.lit("One record per "), "p_brand")).alias("purpose"),
        F.concat(F.coalesce(naming, empty), key, links).alias("extension"),
        F.when(
            k % 2 == 1,
            F.struct(
                F.array(
                    F.struct(F.lit("http://example.org/v3-Confidentiality").alias("system"), F.lit("Restricted").alias("display"))
                ).alias("security")
            ),
        ).alias("meta"),
        F.when(k % 3 == 0, F.array(F.struct(F.col("p_brand").alias("name")))).alias("contact"),
        contexts.alias("useContext"),
        F.struct(F.concat(root, columns).alias("element")).alias("differential"),
    )
    return once(parts, text=F.to_json(document)).select("text", F.lpad(k.cast("string"), 12, "0").alias("path"))


def _tables(spark, sf_dir) -> DataFrame:
    tasks = tasks_of(table(spark, sf_dir, "part"), _DOCUMENTS_PER_TASK)
    return c.parse_tables(d.parse_documents(document_texts(spark, sf_dir), "text", "path"), tasks=tasks)


def _listing(spark, sf_dir) -> DataFrame:
    """Tables that exist: even keys in one project, keys divisible by three in another."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t"))
    names = [F.concat(F.lit("d"), F.col("t") % 7).alias("dataset"), F.concat(F.lit("T"), F.col("t")).alias("table_name")]
    first = keys.where("t % 2 = 0").select(F.lit(0).alias("priority"), F.lit("alpha").alias("project"), *names)
    second = keys.where("t % 3 = 0").select(F.lit(1).alias("priority"), F.lit("beta").alias("project"), *names)
    return second.unionByName(first)


# ---- the same in SQL ----

def _name_sql(t: str) -> str:
    tail = f"'d' || CAST({t} % 7 AS VARCHAR) || '.T' || CAST({t} AS VARCHAR)"
    return f"CASE WHEN {t} % 17 = 0 THEN {tail} WHEN {t} % 19 = 0 THEN 'a.b.c.T' || CAST({t} AS VARCHAR) ELSE 'study.' || {tail} END"


_CODE_LIST = "[" + ", ".join(f"'{TYPE_NAMES.get(x, 'STRING')}'" for x in _CODES) + ", 'STRING']"
_DOCS_SQL = f"""docs AS (
  SELECT *, p_partkey AS k, CASE WHEN p_partkey % 5 = 1 THEN p_partkey - 1 ELSE p_partkey END AS t FROM part
  WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
picked AS (SELECT t, max(k) AS k, min(k) AS first_k FROM docs GROUP BY t),
tabs AS (
  SELECT docs.*, first_k, {_name_sql('docs.t')} AS table_name, '{_URL}p' || CAST(docs.t - docs.t % 3 AS VARCHAR) AS profile_url,
         CASE WHEN docs.k % 2 = 0 THEN 'code' || CAST(p_size AS VARCHAR) ELSE 'KEY_' || CAST(p_size AS VARCHAR) END AS primary_key,
         CASE WHEN docs.k % 4 = 0 THEN '' ELSE 'One record per ' || p_brand END AS purpose
  FROM docs JOIN picked USING (k)),
cols AS (
  SELECT table_name, j AS position, 'col' || CAST(j AS VARCHAR) AS name, ({_CODE_LIST})[CAST((p_size + j) % 10 + 1 AS BIGINT)] AS data_type,
         'Short ' || CAST(j AS VARCHAR) AS short_description, 'Column ' || CAST(j AS VARCHAR) || ' of ' || p_name AS full_description,
         j % 3 = 1 AS is_required,
         CASE WHEN (k + j) % 5 = 0 THEN 'PHI' WHEN (k + j) % 7 = 0 THEN 'UID' END AS sensitivity_label,
         CASE WHEN j % 2 = 0 THEN nullif(concat_ws('; ', CASE WHEN k % 3 <> 0 THEN 'Values of ' || p_name END,
              CASE WHEN k % 4 <> 0 THEN 'strength=required' END), '') END AS value_set_binding,
         CASE WHEN (k + j) % 6 = 0 THEN 'Patient.c' || CAST(j AS VARCHAR) END AS mapping_path,
         CASE WHEN j = 1 THEN 'first column' END AS comment
  FROM tabs, (VALUES (0), (1), (2), (3)) AS v(j) WHERE j <= p_size % 4),
owners AS (SELECT profile_url, arg_max(table_name, first_k) AS owner FROM tabs GROUP BY profile_url),
raw_links AS (
  SELECT table_name, j AS position, '{_URL}p' || CAST((k * 7 + j) % 400 AS VARCHAR) AS target_url
  FROM tabs, (VALUES (0), (1)) AS v(j) WHERE j < k % 3),
links AS (SELECT r.table_name, position, target_url, owner AS target_table FROM raw_links AS r LEFT JOIN owners ON profile_url = target_url),
targets AS (SELECT table_name, string_agg(coalesce(target_table, target_url), ', ' ORDER BY position) AS join_targets FROM links GROUP BY table_name),
listed AS (
  SELECT p_partkey AS t, CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END || '.d' || CAST(p_partkey % 7 AS VARCHAR) || '.T'
         || CAST(p_partkey AS VARCHAR) AS full_name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0),
named AS (SELECT table_name, full_name FROM tabs JOIN listed USING (t) WHERE table_name NOT LIKE 'a.b.c.%')"""


@query(
    "catalog_tables",
    f"""WITH {_DOCS_SQL} SELECT table_name, 'doc-' || CAST(k AS VARCHAR) AS profile_id, profile_url, p_name AS title, p_type AS description,
        purpose, primary_key, CASE WHEN k % 2 = 1 THEN 'Restricted' END AS confidentiality, 'zone ' || CAST(p_size % 3 AS VARCHAR) AS compliance_zone,
        CASE WHEN k % 2 = 0 THEN 'Stable' END AS schema_stability, CAST(k % 10 AS DOUBLE) AS retention_years,
        CASE WHEN k % 3 = 0 THEN p_brand END AS domain_contact FROM tabs""",
)
def catalog_tables(spark, sf_dir):
    return _tables(spark, sf_dir).drop("columns", "link_urls", "doc_path", "first_path")


@query(
    "catalog_columns",
    f"WITH {_DOCS_SQL} SELECT *, CAST(NULL AS VARCHAR) AS mapping_comment, CAST(NULL AS VARCHAR) AS measurement_method FROM cols",
)
def catalog_columns(spark, sf_dir):
    return c.catalog_columns(_tables(spark, sf_dir))


@query("catalog_links", f"WITH {_DOCS_SQL} SELECT * FROM links")
def catalog_links(spark, sf_dir):
    return c.catalog_links(stored(_tables(spark, sf_dir).drop("columns")))


def _with_targets(spark, sf_dir):
    tables = stored(_tables(spark, sf_dir))
    return c.with_targets(tables, c.catalog_links(tables))


_NL = "chr(10)"


@query(
    "catalog_text",
    f"""WITH {_DOCS_SQL}, column_text AS (
          SELECT table_name, string_agg('    - ' || name || ' (' || data_type || ', ' || CASE WHEN is_required THEN 'REQUIRED' ELSE 'OPTIONAL' END
            || coalesce(' [' || sensitivity_label || ']', '') || ')' || {_NL} || '      ' || full_description
            || coalesce({_NL} || '      Allowed values: ' || value_set_binding, '') || coalesce({_NL} || '      FHIR: ' || mapping_path, ''),
            {_NL} ORDER BY position) AS lines FROM cols GROUP BY table_name)
        SELECT table_name, 'TABLE: `' || table_name || '`' || {_NL} || '  Title: ' || p_name || {_NL} || '  Description: ' || p_type || {_NL}
          || '  Grain: ' || purpose || {_NL} || '  Primary Key: ' || primary_key || {_NL}
          || coalesce('  Joins To: ' || join_targets || {_NL}, '') || '  Columns:' || {_NL} || lines AS text
        FROM tabs JOIN column_text USING (table_name) LEFT JOIN targets USING (table_name)""",
)
def catalog_text(spark, sf_dir):
    return c.catalog_text(_with_targets(spark, sf_dir))


@query(
    "catalog_summary",
    f"""WITH {_DOCS_SQL}, names AS (SELECT table_name, string_agg(name, ', ' ORDER BY position) AS names FROM cols GROUP BY table_name)
        SELECT table_name, '\U0001f4ca ' || table_name || {_NL} || '   ' || p_name || {_NL} || '   Key: ' || primary_key || {_NL} || '   Cols: ' || names AS text
        FROM tabs JOIN names USING (table_name)""",
)
def catalog_summary(spark, sf_dir):
    return c.summary_text(_tables(spark, sf_dir))


@query(
    "catalog_detail",
    f"""WITH {_DOCS_SQL}, column_text AS (
          SELECT table_name, string_agg('  ' || name || ' (' || data_type || ', ' || CASE WHEN is_required THEN 'REQUIRED' ELSE 'OPTIONAL' END
            || coalesce(' [' || sensitivity_label || ']', '') || ')' || {_NL} || '    ' || full_description
            || coalesce({_NL} || '    Values: ' || value_set_binding, '') || coalesce({_NL} || '    Note: ' || comment, ''),
            {_NL} ORDER BY position) AS lines FROM cols GROUP BY table_name)
        SELECT table_name, concat_ws({_NL}, 'TABLE: ' || table_name, 'Title: ' || p_name, 'Description: ' || p_type, 'Grain: ' || purpose,
          'Primary Key: ' || primary_key, 'Confidentiality: ' || CASE WHEN k % 2 = 1 THEN 'Restricted' ELSE 'N/A' END,
          'Compliance: zone ' || CAST(p_size % 3 AS VARCHAR), '', 'COLUMNS:', lines)
          || coalesce({_NL} || {_NL} || 'JOINS TO: ' || join_targets, '') AS text
        FROM tabs JOIN column_text USING (table_name) LEFT JOIN targets USING (table_name)""",
)
def catalog_detail(spark, sf_dir):
    return c.detail_text(_with_targets(spark, sf_dir))


@query(
    "catalog_sheet",
    f"""WITH {_DOCS_SQL}, column_text AS (
          SELECT table_name, string_agg('| `' || name || '` | ' || data_type || ' | ' || CASE WHEN is_required THEN '✓' ELSE '' END || ' | '
            || coalesce(sensitivity_label, '-') || ' | ' || substring(short_description, 1, 60) || ' |', {_NL} ORDER BY position) AS lines
          FROM cols GROUP BY table_name),
        joined AS (SELECT table_name, string_agg('- `' || coalesce(target_table, '?') || '`', {_NL} ORDER BY position) AS joins_to FROM links GROUP BY table_name)
        SELECT table_name, concat_ws({_NL}, '## ' || p_name, '**Table:** `' || table_name || '`', '**Description:** ' || p_type,
          '**Grain:** ' || purpose, '**Primary Key:** `' || primary_key || '`', '', '### Columns',
          '| Column | Type | Required | Sensitivity | Description |', '|--------|------|----------|-------------|-------------|', lines)
          || coalesce({_NL} || {_NL} || '### Joins To' || {_NL} || joins_to, '') AS text
        FROM tabs JOIN column_text USING (table_name) LEFT JOIN joined USING (table_name)""",
)
def catalog_sheet(spark, sf_dir):
    return c.sheet_text(_with_targets(spark, sf_dir))


@query(
    "catalog_facts",
    f"""WITH {_DOCS_SQL} SELECT table_name, p_size % 4 + 1 AS column_count, primary_key, coalesce(join_targets, '') AS join_targets
        FROM tabs LEFT JOIN targets USING (table_name)""",
)
def catalog_facts(spark, sf_dir):
    return c.table_facts(_with_targets(spark, sf_dir))


@query("catalog_resolve", f"WITH {_DOCS_SQL} SELECT table_name, full_name FROM named")
def catalog_resolve(spark, sf_dir):
    return c.resolve_names(_tables(spark, sf_dir), _listing(spark, sf_dir)).drop("first_path")


@query(
    "resolved_tables",
    f"WITH {_DOCS_SQL} SELECT full_name AS table_name, p_name AS title, primary_key FROM named JOIN tabs USING (table_name)",
)
def resolved_tables(spark, sf_dir):
    tables = stored(_tables(spark, sf_dir))
    return c.resolve_tables(tables, c.resolve_names(tables, _listing(spark, sf_dir))).select("table_name", "title", "primary_key")


@query(
    "resolved_links",
    f"""WITH {_DOCS_SQL} SELECT s.full_name AS table_name, position, target_url, coalesce(g.full_name, target_table) AS target_table
        FROM links JOIN named AS s ON s.table_name = links.table_name LEFT JOIN named AS g ON g.table_name = links.target_table""",
)
def resolved_links(spark, sf_dir):
    tables = stored(_tables(spark, sf_dir).drop("columns"))
    return c.resolve_links(c.catalog_links(tables), c.resolve_names(tables, _listing(spark, sf_dir)))


@query(
    "listed_names",
    f"WITH {_DOCS_SQL} SELECT substring(full_name, position('.' IN full_name) + 1) AS lookup, full_name FROM listed",
)
def listed_names(spark, sf_dir):
    return c.actual_names(_listing(spark, sf_dir))


def _find_sql(name: str) -> str:
    return f"""SELECT * FROM (SELECT '{name}' AS asked, table_name, table_name = '{name}' AS is_exact FROM tabs
        WHERE contains(lower(table_name), lower('{name}')) ORDER BY table_name = '{name}' DESC, first_k LIMIT 1) AS q"""


@query(
    "find_table",
    f"WITH {_DOCS_SQL} {_find_sql('D2.t1')} UNION ALL {_find_sql('study.d2.T100')} UNION ALL {_find_sql('nosuch')}",
)
def find_table(spark, sf_dir):
    tables = stored(_tables(spark, sf_dir).select("table_name", "first_path"))
    found = None
    for name in ("D2.t1", "study.d2.T100", "nosuch"):
        hit = c.find_table(tables, name).withColumn("asked", F.lit(name))
        found = hit if found is None else found.unionByName(hit)
    return found


@query("available_tables", f"WITH {_DOCS_SQL} SELECT table_name FROM tabs")
def available_tables(spark, sf_dir):
    return c.available_names(_tables(spark, sf_dir))


@query(
    "sensitive_columns",
    f"""WITH {_DOCS_SQL}, chosen AS (
          SELECT DISTINCT l_orderkey AS query_id, {_name_sql('l_partkey')} AS table_name, 'col' || CAST(l_linenumber % 5 AS VARCHAR) AS column_name FROM lineitem)
        SELECT chosen.*, sensitivity_label, coalesce(sensitivity_label IN ('UID', 'PHI'), false) AS is_sensitive
        FROM chosen LEFT JOIN cols ON cols.table_name = chosen.table_name AND cols.name = column_name""",
)
def sensitive_columns(spark, sf_dir):
    selected = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), _name(F.col("l_partkey")).alias("table_name"),
        F.concat(F.lit("col"), F.col("l_linenumber") % 5).alias("column_name"),
    ).distinct()
    return c.flag_sensitive(selected, c.catalog_columns(_tables(spark, sf_dir)))


@query(
    "documents_read",
    f"""WITH {_DOCS_SQL}
        SELECT {_name_sql('t')} AS table_name, arg_max(p_name, p_partkey % 3) || ' v' || CAST(max(p_partkey % 3) + 1 AS VARCHAR) AS title,
               arg_max(p_size, p_partkey % 3) % 4 + 1 AS column_count
        FROM docs GROUP BY t""",
)
def documents_read(spark, sf_dir):
    """Documents as files in subfolders, one to three versions of each and broken ones among them; the last path of a table counts."""
    path = scratch_path(spark, "documents")
    texts = document_texts(spark, sf_dir).withColumn("key", F.col("path").cast("long"))
    titled = F.regexp_replace("text", '"title":"([^"]*)"', F.concat(F.lit('"title":"$1 v'), F.col("version").cast("string"), F.lit('"')))
    versions = texts.withColumn("version", F.explode(F.sequence(F.lit(1), (F.col("key") % 3 + 1).cast("int"))))
    whole = versions.select("key", "version", titled.alias("text"))
    broken = texts.where("key % 50 = 0").select("key", F.lit(9).alias("version"), F.expr("substring(text, 1, length(text) DIV 2)").alias("text"))
    # One line per document; folders keep versions apart and in order.
    whole.unionByName(broken).select("version", "text").write.partitionBy("version").text(path)
    read = d.read_documents(spark, path, lines=True, pattern="*.txt")
    return c.parse_tables(read).select("table_name", "title", F.size("columns").cast("long").alias("column_count"))


_GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query(
    "table_list",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, (SELECT count(*) FROM (DESCRIBE {n})) AS column_count,
            true AS has_bytes, true AS has_time"""
        for n in _GIVEN
    ),
)
def table_list(spark, sf_dir):
    listed = st.table_sizes({n: table(spark, sf_dir, n) for n in _GIVEN})
    return listed.select(
        "table_name", "row_count", "column_count", (F.col("size_bytes") > 0).alias("has_bytes"), F.col("changed").isNotNull().alias("has_time")
    )


_TYPE_SQL = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT[]' THEN 'array<float>' END"""


@query(
    "table_columns",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, position, q.column_name, {_TYPE_SQL} AS data_type, true AS is_nullable, CAST(NULL AS VARCHAR) AS description, r.n
            FROM (SELECT row_number() OVER () AS position, column_name, column_type FROM (DESCRIBE {n})) AS q
            JOIN (UNPIVOT (SELECT count(COLUMNS(*)) FROM {n}) ON * INTO NAME column_name VALUE n) AS r USING (column_name)"""
        for n in _GIVEN
    ),
)
def table_columns(spark, sf_dir):
    """Columns of all given tables with type, whether they may miss values, description, and how many values they have."""
    found = None
    for name in _GIVEN:
        given = table(spark, sf_dir, name)
        counts = column_profile(given).select(F.col("column").alias("column_name"), "n")
        one = st.columns_of(given).join(counts, "column_name").withColumn("table_name", F.lit(name))
        found = one if found is None else found.unionByName(one)
    kind = F.regexp_replace("data_type", "timestamp_ntz", "timestamp")
    return found.select("table_name", F.col("position").cast("long").alias("position"), "column_name", kind.alias("data_type"), "is_nullable", "description", "n")


@query(
    "project_tables",
    " UNION ALL ".join(
        f"SELECT 1 AS priority, 'ward_{w}' AS dataset, '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, true AS has_bytes"
        for w, names in (("a", _GIVEN[::2]), ("b", _GIVEN[1::2])) for n in names
    ),
)
def project_tables(spark, sf_dir):
    """The given tables as catalogue tables of two datasets, listed over two projects of which one is not there, with their facts."""
    folder, listed = scratch_path(spark, "wards"), None
    for w, names in (("a", _GIVEN[::2]), ("b", _GIVEN[1::2])):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS ward_{w} LOCATION '{folder}/{w}'")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS ward_{w}.{n}")
            spark.sql(f"CREATE TABLE ward_{w}.{n} USING parquet LOCATION '{sf_dir.rstrip('/')}/{n}.parquet'")
        facts = st.dataset_tables(spark, f"spark_catalog.ward_{w}", count_rows=True).withColumn("dataset", F.lit(f"ward_{w}"))
        listed = facts if listed is None else listed.unionByName(facts)
    tables = st.list_tables(spark, ["nosuch", "spark_catalog"]).where(F.col("dataset").startswith("ward_"))
    return tables.join(listed, ["dataset", "table_name"]).select(
        "priority", "dataset", "table_name", "row_count", (F.col("size_bytes") > 0).alias("has_bytes")
    )


@query(
    "named_parameters",
    """SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE o_totalprice >= 1000.0 AND c_acctbal < 5000.0 GROUP BY o_orderpriority""",
)
def named_parameters(spark, sf_dir):
    """SQL with named values and frames."""
    return st.sql_with(
        spark,
        """SELECT o_orderpriority, count(*) AS n FROM {orders} JOIN {customers} ON c_custkey = o_custkey
           WHERE o_totalprice >= :least AND c_acctbal < :below GROUP BY o_orderpriority""",
        orders=table(spark, sf_dir, "orders"), customers=table(spark, sf_dir, "customer"), least=1000.0, below=5000.0,
    )
