import json

import pytest
from pyspark.sql import functions as F

from tallygrove.functions.paths import join_paths
from tallygrove.operators import versions as v
from tallygrove.sources import documents as d


def _roots(spark, pairs):
    df = spark.createDataFrame(pairs, "id STRING, parent_id STRING")
    return {r.id: (r.root_id, r.status) for r in v.folder_roots(df).collect()}


def test_folder_roots(spark):
    got = _roots(spark, [("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "q"), ("s", "s")])
    assert got["a"] == got["b"] == got["c"] == ("a", "ok")
    assert got["x"] == got["y"] == (None, "missing_parent")
    assert {got[k] for k in "pqrs"} == {(None, "cycle")}


def test_deep_and_wide_trees(spark):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 300)]
    star = [("hub", None), ("mid", "hub")] + [(f"leaf{i}", "mid") for i in range(500)]
    got = _roots(spark, chain + star)
    assert {got[f"n{i}"] for i in range(300)} == {("n0", "ok")} and {got[f"leaf{i}"] for i in range(500)} == {("hub", "ok")}


@pytest.fixture(scope="module")
def config(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("config")
    prod = {
        "accessTiers": [
            {"shortName": "registered", "datasetsBucket": "", "artifactRegistryRepo": "repo/r"},
            {"shortName": "controlled", "datasetsBucket": "gs://data/", "artifactRegistryRepo": "repo/c"},
        ],
        "cdrVersions": [
            {"name": "R8", "bigqueryProject": "p1", "bigqueryDataset": "d1", "accessTier": "registered", "dcVersionName": "v8", "wgsVdsPath": "x"},
            {"name": "C8", "bigqueryProject": "p2", "bigqueryDataset": "d2", "accessTier": "controlled", "dcVersionName": "v8",
             "storageBasePath": "/v8/", "wgsVdsPath": "wgs/hail.vds", "wgsCramManifestPath": "", "wgsLongReadsManifestPath": "/lr/m.csv"},
            {"name": "C8 again", "accessTier": "controlled", "dcVersionName": "v8"},
        ],
    }
    mapping = [{"dataCollectionUuid": f"c{i}", "cdrEnv": e, "accessTier": t} for i, (e, t) in enumerate([("prod", "registered"), ("prod", "controlled"), ("lab", "controlled"), ("prod", "open")])]
    mapping.insert(0, {"dataCollectionUuid": "c1", "cdrEnv": "lab", "accessTier": "registered"})  # mapped again below
    (root / "prod.json").write_text(json.dumps(prod, indent=1))
    (root / "mapping.json").write_text(json.dumps(mapping, indent=1))
    tiers, versions = d.read_config(spark, str(root / "prod.json"), "prod")
    known = d.read_mapping(spark, str(root / "mapping.json")).toDF("collection_id", "environment", "tier", "position")
    return known, tiers, versions


def test_matching_and_variables(spark, config, rows):
    known, tiers, versions = config
    wanted = spark.createDataFrame(
        [("w0", "c0", "v8"), ("w1", "c1", "v8"), ("w2", "c2", "v8"), ("w3", "c3", "v8"), ("w4", "c1", "v7"), ("w5", "none", "v8")],
        "workspace STRING, collection_id STRING, version STRING",
    )
    matched = v.match_versions(wanted, known, tiers, versions)
    assert rows(matched, "workspace", "status") == [
        ("w0", "ok"), ("w1", "ok"), ("w2", "unknown_environment"), ("w3", "tier_not_found"), ("w4", "version_not_found"), ("w5", "unknown_environment"),
    ]
    found = matched.where("status = 'ok'").withColumns({"workspace_name": F.col("workspace"), "project": F.lit("proj")})
    assert rows(v.path_variables(found, ["workspace"])) == [
        ("w1", "LONG_READS_MANIFEST_PATH", "gs://data/v8/lr/m.csv"), ("w1", "WGS_VDS_PATH", "gs://data/v8/wgs/hail.vds"),
    ]
    every = {(r.workspace, r.variable): r.value for r in v.workspace_variables(found, ["workspace"]).collect()}
    assert every[("w1", "CDR_STORAGE_PATH")] == "gs://data/v8" and ("w0", "CDR_STORAGE_PATH") not in every
    assert every[("w0", "WORKSPACE_CDR")] == "p1.d1" and every[("w0", "ARTIFACT_REGISTRY_DOCKER_REPO")] == "repo/r"
    assert every[("w1", "WORKSPACE_BUCKET")] == "gs://cloned-mybucket-proj" and every[("w1", "BIGQUERY_STORAGE_API_ENABLED")] == "true"
    assert len([k for k in every if k[0] == "w0"]) == 8 and len([k for k in every if k[0] == "w1"]) == 11


def test_workspace_versions(spark, rows):
    folders = spark.createDataFrame([("f1", None, "v7"), ("f2", "f1", "x"), ("f3", "gone", "y")], "id STRING, parent_id STRING, display_name STRING")
    entry = "ARRAY<STRUCT<source_resource: STRING, source_workspace: STRING>>"
    resources = spark.createDataFrame(
        [
            ("w1", 1, [("r1", "other")]), ("w1", 2, [("r3", "c1"), ("r2", "c1"), ("r1", "c2")]), ("w1", 3, [("r1", "c2")]),
            ("w2", 1, []), ("w3", 1, None),
        ],
        f"workspace_id STRING, resource_order INT, lineage {entry}",
    )
    mapping = spark.createDataFrame([("c1",), ("c2",)], "collection_id STRING")
    sources = spark.createDataFrame([("c1", "r2", "f2"), ("c1", "r3", "f3"), ("c2", "r1", "f1")], "workspace_id STRING, resource_id STRING, folder_id STRING")
    got = v.workspace_versions(resources, mapping, sources, folders, v.folder_roots(folders))
    assert rows(got) == [("w1", "c1", "v7")]


def test_join_paths(spark):
    df = spark.createDataFrame([("gs://b/", "/v8/", "/"), ("a//", "", None), ("/", "x/y/", "z")], "a STRING, b STRING, c STRING")
    got = [r[0] for r in df.select(join_paths(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["gs://b/v8", "a", "x/y/z"]
