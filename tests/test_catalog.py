import json

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import catalog as c
from tallygrove.sources import documents as d

BASE = "http://example.org/StructureDefinition/"


def _document(name, url, **parts):
    extension = [{"url": BASE + "BigQueryTableSchemaMetadata", "extension": [{"url": "other"}, {"url": "table-name", "valueString": name}]}]
    return {"resourceType": "StructureDefinition", "id": name, "url": url, "extension": extension + parts.pop("extension", []), **parts}


RICH = _document(
    "study.admin.ONE", "u1", title="One", description="first", purpose="one per person",
    extension=[
        {"url": BASE + "primary-identity", "valueString": "", "valueCanonical": "", "valueCode": "SUBJECT"},
        {"url": BASE + "structural-link", "valueCanonical": "u2"},
        {"url": BASE + "structural-link", "valueCanonical": "u-unknown"},
        {"url": BASE + "structural-link"},
    ],
    meta={"security": [{"system": "x/v3-Confidentiality", "display": "Normal"}, {"system": "x/v3-Confidentiality", "display": "Restricted"}, {"system": "y", "display": "no"}]},
    contact=[{"name": "desk"}, {"name": "other"}],
    useContext=[
        {"code": {"code": "compliance-zone"}, "valueCodeableConcept": {"coding": [{"display": "HIPAA"}, {"display": "no"}]}},
        {"code": {"code": "compliance-zone"}, "valueCodeableConcept": {"coding": []}},
        {"code": {"code": "retention-policy"}, "valueQuantity": {"value": 7}},
        {"code": {"code": "schema-stability"}, "valueCodeableConcept": {"coding": [{"display": "Stable"}]}},
    ],
    differential={
        "element": [
            {"path": "ONE"},
            {
                "path": "ONE.sub.SUBJECT", "min": 1, "short": "id", "definition": "subject id", "comment": "keep",
                "type": [{"code": "string"}, {"code": "date"}],
                "extension": [
                    {"url": "x/extension-inline-sec-label", "valueCoding": {"system": "z", "code": "NO"}},
                    {"url": "x/extension-inline-sec-label", "valueCoding": {"system": BASE + "SensitivityLabels", "code": "UID"}},
                    {"url": BASE + "attribute-semantic-metadata", "extension": [{"url": "measurement-method", "valueCodeableConcept": {"text": "", "coding": [{"display": "assay"}]}}]},
                ],
                "binding": {"description": "yes or no", "strength": "required"},
                "mapping": [{"identity": "a", "map": "no"}, {"identity": "vfig", "map": "Patient.id", "comment": "as is"}],
            },
            {"path": "ONE.score", "min": 0, "type": [{"code": "decimal"}], "binding": {"description": "", "strength": ""}},
            {"path": "ONE.when", "type": [{"code": "instant"}], "binding": {"strength": "example"}},
            {"path": "ONE.odd", "type": [{"code": "Quantity"}]},
            {"path": "ONE.bare"},
        ]
    },
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    (root / "sub").mkdir()
    documents = {
        "a.json": RICH,
        "b.json": _document("study.admin.TWO", "u2", title="old"),
        "sub/c.json": _document("study.admin.TWO", "u2", title="new"),
        "d.json": {"resourceType": "ValueSet", "id": "x"},
        "e.json": {"resourceType": "StructureDefinition", "id": "no extension"},
        "f.json": _document("", "u3"),
        "g.json": _document("analysis.FOUR", "u2"),
        "h.json": _document("a.b.c.FIVE", "u5"),
        "i.txt": _document("study.admin.TEXT", "u6"),
    }
    for name, document in documents.items():
        (root / name).write_text(json.dumps(document, indent=1))
    (root / "broken.json").write_text('{"resourceType": "StructureDefinition", ')
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, folder):
    return c.parse_tables(d.read_documents(spark, folder)).cache()


def test_reading(spark, folder, tables, rows):
    assert rows(tables, "table_name", "title") == [
        ("a.b.c.FIVE", ""), ("analysis.FOUR", ""), ("study.admin.ONE", "One"), ("study.admin.TWO", "new"),
    ]
    flat = c.parse_tables(d.read_documents(spark, folder, recursive=False))
    assert rows(flat.where("table_name = 'study.admin.TWO'"), "title") == [("old",)]


def test_table_fields(tables):
    r = tables.where("table_name = 'study.admin.ONE'").first()
    assert (r.profile_id, r.primary_key, r.confidentiality, r.compliance_zone, r.schema_stability, r.retention_years, r.domain_contact) == (
        "study.admin.ONE", "SUBJECT", "Restricted", "HIPAA", "Stable", 7.0, "desk",
    )
    plain = tables.where("table_name = 'analysis.FOUR'").first()
    assert (plain.primary_key, plain.confidentiality, plain.columns, plain.link_urls) == ("", None, [], [])


def test_columns(tables, rows):
    columns = c.catalog_columns(tables)
    assert rows(columns, "position", "name", "data_type", "is_required") == [
        (0, "SUBJECT", "STRING", True), (1, "score", "FLOAT", False), (2, "when", "TIMESTAMP", False), (3, "odd", "STRING", False),
        (4, "bare", "STRING", False),
    ]
    first = columns.where("position = 0").first()
    assert (first.sensitivity_label, first.value_set_binding, first.mapping_path, first.mapping_comment, first.measurement_method, first.comment) == (
        "UID", "yes or no; strength=required", "Patient.id", "as is", "assay", "keep",
    )
    assert [r.value_set_binding for r in columns.where("position > 0").orderBy("position").collect()] == [None, "strength=example", None, None]


def test_links_and_resolution(spark, tables, rows):
    links = c.catalog_links(tables)
    assert rows(links, "position", "target_url", "target_table") == [(0, "u2", "analysis.FOUR"), (1, "u-unknown", None), (2, "", None)]
    listed = spark.createDataFrame(
        [(1, "second", "admin", "ONE"), (0, "first", "admin", "ONE"), (1, "second", "analysis", "FOUR"), (0, "first", "c", "FIVE")],
        "priority INT, project STRING, dataset STRING, table_name STRING",
    )
    names = c.resolve_names(tables, listed)
    assert rows(names, "table_name", "full_name") == [("analysis.FOUR", "second.analysis.FOUR"), ("study.admin.ONE", "first.admin.ONE")]
    assert rows(c.resolve_tables(tables, names), "table_name") == [("first.admin.ONE",), ("second.analysis.FOUR",)]
    assert rows(c.resolve_links(links, names), "table_name", "target_table") == [
        ("first.admin.ONE", "second.analysis.FOUR"), ("first.admin.ONE", None), ("first.admin.ONE", None),
    ]


def test_two_names_for_one_table(spark, rows):
    tables = spark.createDataFrame(
        [("x.admin.T", "1", "u", "old"), ("y.admin.T", "2", "v", "new")], "table_name STRING, first_path STRING, profile_url STRING, title STRING"
    )
    listed = spark.createDataFrame([(0, "p", "admin", "T")], "priority INT, project STRING, dataset STRING, table_name STRING")
    names = c.resolve_names(tables, listed)
    assert rows(c.resolve_tables(tables, names), "table_name", "title") == [("p.admin.T", "new")]


def test_texts(tables):
    full = c.with_targets(tables, c.catalog_links(tables))
    text = {r.table_name: r.text for r in c.catalog_text(full).collect()}["study.admin.ONE"].split("\n")
    assert text[:9] == [
        "TABLE: `study.admin.ONE`", "  Title: One", "  Description: first", "  Grain: one per person", "  Primary Key: SUBJECT",
        "  Joins To: analysis.FOUR, u-unknown, ", "  Columns:", "    - SUBJECT (STRING, REQUIRED [UID])", "      subject id",
    ]
    assert text[9:11] == ["      Allowed values: yes or no; strength=required", "      FHIR: Patient.id"]
    detail = {r.table_name: r.text for r in c.detail_text(full).collect()}
    assert "    Note: keep" in detail["study.admin.ONE"] and "Confidentiality: N/A" in detail["analysis.FOUR"]
    assert detail["study.admin.ONE"].endswith("\n\nJOINS TO: analysis.FOUR, u-unknown, ")
    sheet = {r.table_name: r.text for r in c.sheet_text(full).collect()}["study.admin.ONE"]
    assert "| `SUBJECT` | STRING | ✓ | UID | id |" in sheet and sheet.endswith("### Joins To\n- `analysis.FOUR`\n- `?`\n- `?`")
    short = {r.table_name: r.text for r in c.summary_text(full).collect()}["study.admin.ONE"]
    assert short.endswith("   Key: SUBJECT\n   Cols: SUBJECT, score, when, odd, bare")
    facts = {r.table_name: r for r in c.table_facts(full).collect()}
    assert (facts["study.admin.ONE"].column_count, facts["analysis.FOUR"].join_targets) == (5, "")


def test_finding_and_flagging(spark, tables, rows):
    assert rows(c.find_table(tables, "study.admin.TWO")) == [("study.admin.TWO", True)]
    assert rows(c.find_table(tables, "ADMIN")) == [("study.admin.ONE", False)]
    assert rows(c.find_table(tables, "nothing")) == []
    assert rows(c.available_names(tables))[0] == ("a.b.c.FIVE",)
    selected = spark.createDataFrame([("study.admin.ONE", "SUBJECT"), ("study.admin.ONE", "score"), ("x", "y")], "table_name STRING, column_name STRING")
    assert rows(c.flag_sensitive(selected, c.catalog_columns(tables)), "column_name", "is_sensitive") == [("SUBJECT", True), ("score", False), ("y", False)]


def test_parsing_from_texts(spark, folder, rows):
    texts = spark.createDataFrame([("1", json.dumps(RICH)), ("2", '{"resourceType": '), ("3", None)], "path STRING, text STRING")
    assert rows(c.parse_tables(d.parse_documents(texts, "text", "path")), "table_name") == [("study.admin.ONE",)]


def test_whole_urls_limit_the_match(spark, tables, folder):
    words = c.Vocabulary(table_name="http://other.org/BigQueryTableSchemaMetadata")
    assert c.parse_tables(d.read_documents(spark, folder), words).count() == 0


def test_type_names(spark):
    codes = ["string", "code", "integer", "decimal", "boolean", "date", "dateTime", "instant", "x", None]
    df = spark.createDataFrame([(x,) for x in codes], "code STRING").select(c.type_name(F.col("code")))
    assert [r[0] for r in df.collect()] == ["STRING", "STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP", "TIMESTAMP", "STRING", "STRING"]
