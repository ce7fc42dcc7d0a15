"""Table catalogue out of description documents: tables, columns, links, name resolution, texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DOCUMENT_KIND, MAPPING_IDENTITY, SENSITIVE_LABELS, SHEET_WIDTH, TYPE_DEFAULT, TYPE_NAMES
from ..functions.once import once
from ..functions.paths import last_part


@dataclass(frozen=True)
class Vocabulary:
    """Ends of the extension URLs and code systems; give whole URLs to match one publisher only."""

    table_name: str = "BigQueryTableSchemaMetadata"
    primary_key: str = "primary-identity"
    link: str = "structural-link"
    label: str = "extension-inline-sec-label"
    label_system: str = "SensitivityLabels"
    semantics: str = "attribute-semantic-metadata"


DEFAULT_VOCABULARY = Vocabulary()


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _text(value: Column) -> Column:
    """Empty text counts as absent."""
    return F.nullif(value, F.lit(""))


def _with_url(items: Column, url: str) -> Column:
    return F.filter(items, lambda e: e["url"].endswith(url))


def _sub(items: Column, url: str, part: str) -> Column:
    """Named parts of all extensions of a URL."""
    nested = F.transform(F.filter(items, lambda e: e["url"].endswith(url) & e["extension"].isNotNull()), lambda e: e["extension"])
    return F.filter(F.flatten(nested), lambda s: s["url"] == part)


def extension_value(items: Column, url: str) -> Column:
    """First extension of a URL: text, else canonical, else code."""
    hit = _first(_with_url(items, url))
    return F.coalesce(_text(hit["valueString"]), _text(hit["valueCanonical"]), _text(hit["valueCode"]))


def type_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(TYPE_DEFAULT))


def _context(code: str, value) -> Column:
    """Last use-context value of a code that is filled."""
    picked = F.transform(F.filter("useContext", lambda c: c["code"]["code"] == code), value)
    return F.try_element_at(picked, F.lit(-1))


def _context_display(code: str) -> Column:
    coded = F.filter(
        "useContext",
        lambda c: (c["code"]["code"] == code) & (F.size(c["valueCodeableConcept"]["coding"]) > 0),
    )
    return _first(F.try_element_at(coded, F.lit(-1))["valueCodeableConcept"]["coding"])["display"]


def _column(element: Column, words: Vocabulary) -> Column:
    method = _first(_sub_of_element(element, words))["valueCodeableConcept"]
    label = _first(
        F.filter(
            element["extension"],
            lambda e: e["url"].endswith(words.label) & e["valueCoding"]["system"].endswith(words.label_system),
        )
    )["valueCoding"]["code"]
    mapping = _first(F.filter(element["mapping"], lambda m: m["identity"] == MAPPING_IDENTITY))
    binding = F.concat_ws(
        "; ",
        _text(element["binding"]["description"]),
        F.concat(F.lit("strength="), _text(element["binding"]["strength"])),
    )
    return F.struct(
        last_part(element["path"]).alias("name"),
        type_name(F.coalesce(_first(element["type"])["code"], F.lit("string"))).alias("data_type"),
        F.coalesce(element["short"], F.lit("")).alias("short_description"),
        F.coalesce(element["definition"], F.lit("")).alias("full_description"),
        (F.coalesce(element["min"], F.lit(0)) >= 1).alias("is_required"),
        label.alias("sensitivity_label"),
        _text(binding).alias("value_set_binding"),
        mapping["map"].alias("mapping_path"),
        mapping["comment"].alias("mapping_comment"),
        F.coalesce(_text(method["text"]), _first(method["coding"])["display"]).alias("measurement_method"),
        element["comment"].alias("comment"),
    )


def _sub_of_element(element: Column, words: Vocabulary) -> Column:
    return _sub(element["extension"], words.semantics, "measurement-method")


def parse_tables(documents: DataFrame, words: Vocabulary = DEFAULT_VOCABULARY, tasks: int | None = None) -> DataFrame:
    """One row per described table, its columns and links nested; a later document of the same table wins.

    Everything about a document stays in its own row, so the one shuffle is the choice among
    documents of the same table name, which is combined before it. Tasks after it sort wide rows; where their number
    is known to the caller, ``tasks`` of them share the tables by name, and documents are combined after the shuffle.
    """
    name = _first(_sub(F.col("extension"), words.table_name, "table-name"))["valueString"]
    security = F.filter(F.col("meta.security"), lambda s: s["system"].contains("Confidentiality"))
    parsed = (
        once(documents.where(F.col("resourceType") == DOCUMENT_KIND), table_name=_text(name))
        .where(F.col("table_name").isNotNull())
        .select(
            "table_name",
            "doc_path",
            F.coalesce("id", F.lit("")).alias("profile_id"),
            F.coalesce("url", F.lit("")).alias("profile_url"),
            *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "purpose")],
            F.coalesce(extension_value(F.col("extension"), words.primary_key), F.lit("")).alias("primary_key"),
            F.try_element_at(security, F.lit(-1))["display"].alias("confidentiality"),
            _context_display("compliance-zone").alias("compliance_zone"),
            _context_display("schema-stability").alias("schema_stability"),
            _context("retention-policy", lambda c: c["valueQuantity"]["value"]).alias("retention_years"),
            _first(F.col("contact"))["name"].alias("domain_contact"),
            F.coalesce(
                F.transform(
                    F.filter("differential.element", lambda e: e["path"].contains(".")), lambda e: _column(e, words)
                ),
                F.array(),
            ).alias("columns"),
            F.coalesce(
                F.transform(
                    _with_url(F.col("extension"), words.link), lambda e: F.coalesce(e["valueCanonical"], F.lit(""))
                ),
                F.array(),
            ).alias("link_urls"),
        )
    )
    fields = [c for c in parsed.columns if c != "table_name"]
    if tasks:
        parsed = parsed.repartition(tasks, "table_name")
    return (
        parsed.groupBy("table_name")
        .agg(F.max_by(F.struct(*fields), "doc_path").alias("t"), F.min("doc_path").alias("first_path"))
        .select("table_name", "t.*", "first_path")
    )


def catalog_columns(tables: DataFrame) -> DataFrame:
    """One row per column with its position."""
    return tables.select("table_name", F.posexplode("columns").alias("position", "c")).select(
        "table_name", "position", "c.*"
    )


def catalog_links(tables: DataFrame) -> DataFrame:
    """One row per link; the target is the last table that has the URL, or NULL.

    Owners are as many as tables. Their size is estimated far too low, and adaptive execution does not take back a broadcast.
    """
    links = tables.select("table_name", F.posexplode("link_urls").alias("position", "target_url"))
    owners = tables.groupBy(F.col("profile_url").alias("target_url")).agg(
        F.max_by("table_name", "first_path").alias("target_table")
    )
    return links.join(owners.hint("merge"), "target_url", "left").select("table_name", "position", "target_url", "target_table")


def actual_names(listed: DataFrame) -> DataFrame:
    """One full name per (dataset, table) of a listing over several projects; the first project wins."""
    return listed.groupBy(F.concat_ws(".", "dataset", "table_name").alias("lookup")).agg(
        F.min_by(F.concat_ws(".", "project", "dataset", "table_name"), "priority").alias("full_name")
    )


def resolve_names(tables: DataFrame, listed: DataFrame) -> DataFrame:
    """Described names that exist, with their full names: the first of three parts is dropped, other shapes are skipped."""
    parts = F.split("table_name", "\\.")
    lookup = F.when(F.size(parts) == 3, F.concat_ws(".", parts[1], parts[2])).when(
        F.size(parts) == 2, F.col("table_name")
    )
    return (
        tables.select("table_name", "first_path", lookup.alias("lookup"))
        .where(F.col("lookup").isNotNull())
        .join(actual_names(listed), "lookup")
        .select("table_name", "full_name", "first_path")
    )


def resolve_tables(tables: DataFrame, names: DataFrame) -> DataFrame:
    """Tables that exist under their full names; of two with the same full name the later one wins."""
    winners = names.groupBy("full_name").agg(F.max_by("table_name", "first_path").alias("table_name"))
    return tables.join(winners, "table_name").withColumn("table_name", F.col("full_name")).drop("full_name")


def resolve_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links of existing tables with full names; a target that does not exist keeps its old name."""
    kept = names.groupBy("full_name").agg(F.max_by("table_name", "first_path").alias("table_name"))
    targets = names.select(F.col("table_name").alias("target_table"), F.col("full_name").alias("__target"))
    return (
        links.join(kept, "table_name")
        .join(targets, "target_table", "left")
        .select(
            F.col("full_name").alias("table_name"),
            "position",
            "target_url",
            F.coalesce("__target", "target_table").alias("target_table"),
        )
    )


def with_targets(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Tables with an array of link targets in order; a document's own links are all that gather per table.

    Targets grow with the tables and are not broadcast, as owners of links are not.
    """
    targets = links.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("position", "target_url", "target_table"))).alias("links")
    )
    return tables.join(targets.hint("merge"), "table_name", "left").withColumn("links", F.coalesce("links", F.array()))


def _lines(*parts: Column) -> Column:
    """Text lines of several arrays; missing lines fall out."""
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull()), "\n")


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _marks(c: Column) -> Column:
    label = F.when(_text(c["sensitivity_label"]).isNotNull(), F.concat(F.lit(" ["), c["sensitivity_label"], F.lit("]")))
    return F.concat(
        c["name"], F.lit(" ("), c["data_type"], F.lit(", "),
        F.when(c["is_required"], "REQUIRED").otherwise("OPTIONAL"), F.coalesce(label, F.lit("")), F.lit(")"),
    )


def _targets(missing: str | None = None) -> Column:
    return F.transform(
        "links",
        lambda k: F.coalesce(k["target_table"], F.lit(missing) if missing else k["target_url"]),
    )


def catalog_text(tables: DataFrame) -> DataFrame:
    """Long text of each table, tables sorted by name."""
    columns = F.flatten(
        F.transform(
            "columns",
            lambda c: F.array(
                _line("    - ", _marks(c)),
                _line("      ", c["full_description"]),
                _line("      Allowed values: ", _text(c["value_set_binding"])),
                _line("      FHIR: ", _text(c["mapping_path"])),
            ),
        )
    )
    head = F.array(
        F.concat(F.lit("TABLE: `"), F.col("table_name"), F.lit("`")),
        _line("  Title: ", F.col("title")),
        _line("  Description: ", F.col("description")),
        _line("  Grain: ", F.col("purpose")),
        _line("  Primary Key: ", F.col("primary_key")),
        F.when(F.size("links") > 0, _line("  Joins To: ", F.array_join(_targets(), ", "))),
        F.lit("  Columns:"),
    )
    return tables.select("table_name", _lines(head, columns).alias("text")).orderBy("table_name")


def summary_text(tables: DataFrame) -> DataFrame:
    """Short text of each table: title, key, column names."""
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ", ")
    head = F.array(
        _line("\U0001f4ca ", F.col("table_name")), _line("   ", F.col("title")),
        _line("   Key: ", F.col("primary_key")), _line("   Cols: ", names),
    )
    return tables.select("table_name", _lines(head).alias("text")).orderBy("table_name")


def detail_text(tables: DataFrame) -> DataFrame:
    """Text of single tables with confidentiality, notes and allowed values."""
    columns = F.flatten(
        F.transform(
            "columns",
            lambda c: F.array(
                _line("  ", _marks(c)),
                _line("    ", c["full_description"]),
                _line("    Values: ", _text(c["value_set_binding"])),
                _line("    Note: ", _text(c["comment"])),
            ),
        )
    )
    head = F.array(
        _line("TABLE: ", F.col("table_name")), _line("Title: ", F.col("title")),
        _line("Description: ", F.col("description")), _line("Grain: ", F.col("purpose")),
        _line("Primary Key: ", F.col("primary_key")),
        _line("Confidentiality: ", F.coalesce(_text(F.col("confidentiality")), F.lit("N/A"))),
        _line("Compliance: ", F.coalesce(_text(F.col("compliance_zone")), F.lit("N/A"))),
        F.lit(""), F.lit("COLUMNS:"),
    )
    joins = F.when(
        F.size("links") > 0, F.array(F.lit(""), _line("JOINS TO: ", F.array_join(_targets(), ", ")))
    ).otherwise(F.array().cast("array<string>"))
    return tables.select("table_name", _lines(head, columns, joins).alias("text"))


def sheet_text(tables: DataFrame, width: int = SHEET_WIDTH) -> DataFrame:
    """Text of single tables as a sheet with a column table; descriptions are cut to a width."""
    columns = F.transform(
        "columns",
        lambda c: F.concat(
            F.lit("| `"), c["name"], F.lit("` | "), c["data_type"], F.lit(" | "),
            F.when(c["is_required"], "✓").otherwise(""), F.lit(" | "),
            F.coalesce(_text(c["sensitivity_label"]), F.lit("-")), F.lit(" | "),
            F.substring(c["short_description"], 1, width), F.lit(" |"),
        ),
    )

    def quoted(label: str, name: str) -> Column:
        return F.concat(F.lit(f"**{label}:** `"), F.col(name), F.lit("`"))

    head = F.array(
        _line("## ", F.col("title")), quoted("Table", "table_name"),
        _line("**Description:** ", F.col("description")), _line("**Grain:** ", F.col("purpose")),
        quoted("Primary Key", "primary_key"), F.lit(""), F.lit("### Columns"),
        F.lit("| Column | Type | Required | Sensitivity | Description |"),
        F.lit("|--------|------|----------|-------------|-------------|"),
    )
    joins = F.when(
        F.size("links") > 0,
        F.concat(
            F.array(F.lit(""), F.lit("### Joins To")),
            F.transform(_targets("?"), lambda t: F.concat(F.lit("- `"), t, F.lit("`"))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return tables.select("table_name", _lines(head, columns, joins).alias("text"))


def table_facts(tables: DataFrame) -> DataFrame:
    """Column count, key and join targets of each table."""
    return tables.select(
        "table_name",
        F.size("columns").cast("long").alias("column_count"),
        "primary_key",
        F.array_join(_targets(), ", ").alias("join_targets"),
    )


def find_table(tables: DataFrame, name: str) -> DataFrame:
    """The table of that name, else the first whose name holds it in any case, else no row.

    One aggregate over (rank, order); only the best candidate of each task is shuffled.
    """
    rank = F.when(F.col("table_name") == name, 0).when(F.lower("table_name").contains(name.lower()), 1)
    best = tables.select(F.struct(rank.alias("rank"), "first_path", "table_name").alias("hit"), rank.alias("__rank"))
    return (
        best.where(F.col("__rank").isNotNull())
        .agg(F.min("hit").alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(F.col("hit.table_name"), (F.col("hit.rank") == 0).alias("is_exact"))
    )


def available_names(tables: DataFrame) -> DataFrame:
    return tables.select("table_name").orderBy("table_name")


def flag_sensitive(selected: DataFrame, columns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Selected columns with the label of the catalogue and a flag; none is dropped."""
    on = keys or ["table_name", "column_name"]
    labels = columns.select("table_name", F.col("name").alias("column_name"), "sensitivity_label")
    return selected.join(labels, on, "left").withColumn(
        "is_sensitive", F.coalesce(F.col("sensitivity_label").isin(*SENSITIVE_LABELS), F.lit(False))
    )
