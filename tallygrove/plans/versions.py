"""Folder roots, lineage, version match and variables over a forest made from customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STATIC_VARIABLES, VERSION_PATHS
from ..operators import versions as v
from ..session import scratch_path
from ..sources import documents as d
from . import query
from .bind import table

# Path fields that are filled by rule; the three others have forms of their own.
_OTHER_PATHS = [
    (i, f) for i, f in enumerate(VERSION_PATHS) if f not in ("wgsVdsPath", "wgsCramManifestPath", "wgsLongReadsManifestPath")
]

# ---- made inputs, in Spark ----


def _folders(spark, sf_dir) -> DataFrame:
    """A binary forest with seven roots, some folders without a parent row and some that are their own parent."""
    f = F.col("id")
    parent = (
        F.when(f < 8, None).when(f % 97 == 0, f + 1_000_000_000_000).when(f % 101 == 0, f).otherwise(F.floor(f / 2))
    )
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id")).select(
        "id", parent.cast("long").alias("parent_id"), F.concat(F.lit("cdrv"), f % 3 + 7).alias("display_name")
    )


def _pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _mapping(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")

    def rows(shift: int) -> DataFrame:
        return nations.select(
            F.concat(F.lit("c"), n).alias("collection_id"),
            _pick(["test", "stable", "prod", "lab"], (n + shift) % 4).alias("environment"),
            _pick(["registered", "controlled"], (n + shift) % 2).alias("tier"),
            (n + shift * 1000).alias("position"),
        )

    # Every third collection is mapped again further down; the later row counts.
    return rows(0).unionByName(rows(1).where("position % 3 = 0"))


def _tiers(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        _pick(["test", "stable", "prod"], n % 3).alias("environment"),
        n.alias("position"),
        _pick(["registered", "controlled"], n % 2).alias("shortName"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("gs://b"), n, F.lit("/"))).alias("datasetsBucket"),
        F.concat(F.lit("repo"), n).alias("artifactRegistryRepo"),
    )


def _versions(spark, sf_dir) -> DataFrame:
    s = F.col("s_suppkey")
    text = s.cast("string")
    return table(spark, sf_dir, "supplier").select(
        _pick(["test", "stable", "prod"], s % 3).alias("environment"),
        s.alias("position"),
        _pick(["registered", "controlled"], s % 2).alias("accessTier"),
        F.concat(F.lit("cdrv"), s % 5 + 6).alias("dcVersionName"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("proj-"), text).alias("bigqueryProject"),
        F.concat(F.lit("d"), text).alias("bigqueryDataset"),
        F.when(s % 7 == 0, "").otherwise(F.concat(F.lit("/v"), s % 5, F.lit("/"))).alias("storageBasePath"),
        F.concat(F.lit("wgs/"), text, F.lit("/hail.vds")).alias("wgsVdsPath"),
        F.when(s % 2 == 0, F.concat(F.lit("/cram/"), text, F.lit("/"))).otherwise("").alias("wgsCramManifestPath"),
        F.when(s % 3 == 0, F.concat(F.lit("lr/"), text)).alias("wgsLongReadsManifestPath"),
        *[F.when(s % (i % 5 + 2) == 0, "").otherwise(F.concat(F.lit(f"f{i}/"), text)).alias(f) for i, f in _OTHER_PATHS],
    )


def _entry(resource: Column, workspace: Column) -> Column:
    return F.struct(
        F.concat(F.lit("r"), resource).alias("source_resource"), F.concat(F.lit("c"), workspace).alias("source_workspace")
    )


def _resources(spark, sf_dir) -> DataFrame:
    """One resource per order; customers play the workspaces."""
    o = F.col("o_orderkey")
    first, second = o * 7 % 149, o * 3 % 149
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("workspace_id"),
        o.alias("resource_order"),
        F.array(_entry(first, first % 40), _entry(second, second % 25)).alias("lineage"),
    )


def _source_resources(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key % 25).alias("workspace_id"), F.concat(F.lit("r"), key).alias("resource_id"), (key + 1).alias("folder_id")
    )


# ---- the same in SQL ----

_FOREST_SQL = """RECURSIVE folders AS (
  SELECT id, CASE WHEN id < 8 THEN NULL WHEN id % 97 = 0 THEN id + 1000000000000 WHEN id % 101 = 0 THEN id ELSE id // 2 END AS parent_id,
         'cdrv' || CAST(id % 3 + 7 AS VARCHAR) AS display_name FROM (SELECT c_custkey + 1 AS id FROM customer) AS q),
walk AS (
  SELECT id, id AS root_id, 'ok' AS status FROM folders WHERE parent_id IS NULL
  UNION ALL SELECT id, NULL, 'missing_parent' FROM folders WHERE parent_id > 1000000000000
  UNION ALL SELECT f.id, w.root_id, w.status FROM folders AS f JOIN walk AS w ON f.parent_id = w.id),
roots AS (SELECT f.id, root_id, coalesce(status, 'cycle') AS status FROM folders AS f LEFT JOIN walk USING (id))"""

_LINEAGE_SQL = f"""{_FOREST_SQL},
mapping AS (SELECT 'c' || CAST(n_nationkey AS VARCHAR) AS collection_id, (['test', 'stable', 'prod', 'lab'])[(n_nationkey + again) % 4 + 1] AS environment,
                   (['registered', 'controlled'])[(n_nationkey + again) % 2 + 1] AS tier
            FROM (SELECT *, CASE WHEN (n_nationkey + 1000) % 3 = 0 THEN 1 ELSE 0 END AS again FROM nation)),
entries AS (
  SELECT o_custkey AS workspace_id, o_orderkey AS resource_order, 0 AS position, o_orderkey * 7 % 149 AS r, o_orderkey * 7 % 149 % 40 AS w FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 1, o_orderkey * 3 % 149, o_orderkey * 3 % 149 % 25 FROM orders),
resolved AS (
  SELECT e.workspace_id, resource_order, position, 'c' || CAST(w AS VARCHAR) AS collection_id, g.display_name AS version
  FROM entries AS e JOIN customer ON c_custkey = r AND c_custkey % 25 = w JOIN roots ON roots.id = c_custkey + 1 AND status = 'ok'
  JOIN folders AS g ON g.id = root_id WHERE w < 25),
workspace_version AS (
  SELECT workspace_id, collection_id, version FROM (
    SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY resource_order, position) AS rn FROM resolved) AS q WHERE rn = 1)"""

_MATCH_SQL = f"""{_LINEAGE_SQL},
tiers AS (
  SELECT (['test', 'stable', 'prod'])[n_nationkey % 3 + 1] AS environment, (['registered', 'controlled'])[n_nationkey % 2 + 1] AS tier,
         min(n_nationkey) AS n FROM nation GROUP BY ALL),
versions AS (
  SELECT (['test', 'stable', 'prod'])[s_suppkey % 3 + 1] AS environment, (['registered', 'controlled'])[s_suppkey % 2 + 1] AS tier,
         'cdrv' || CAST(s_suppkey % 5 + 6 AS VARCHAR) AS version, min(s_suppkey) AS s FROM supplier GROUP BY ALL),
wanted AS (
  SELECT workspace_id, CASE WHEN workspace_id % 31 = 0 THEN 'unknown' ELSE collection_id END AS collection_id,
         CASE WHEN workspace_id % 29 = 0 THEN 'cdrv0' ELSE version END AS version FROM workspace_version),
matched AS (
  SELECT workspace_id, wanted.collection_id, wanted.version, mapping.environment, mapping.tier, tiers.n, versions.s,
         CASE WHEN coalesce(mapping.environment, '') NOT IN ('test', 'stable', 'prod') THEN 'unknown_environment'
              WHEN tiers.n IS NULL THEN 'tier_not_found' WHEN versions.s IS NULL THEN 'version_not_found' ELSE 'ok' END AS status,
         CASE WHEN tiers.n % 5 = 0 THEN '' ELSE 'gs://b' || CAST(tiers.n AS VARCHAR) || '/' END AS bucket,
         CASE WHEN s % 7 = 0 THEN '' ELSE 'v' || CAST(s % 5 AS VARCHAR) END AS base
  FROM wanted LEFT JOIN mapping USING (collection_id)
  LEFT JOIN tiers ON tiers.environment = mapping.environment AND tiers.tier = mapping.tier
  LEFT JOIN versions ON versions.environment = mapping.environment AND versions.tier = mapping.tier AND versions.version = wanted.version),
based AS (SELECT *, CASE WHEN bucket <> '' AND base <> '' THEN trim(bucket, '/') || '/' || base END AS root FROM matched WHERE status = 'ok'),
paths AS (
  SELECT workspace_id, 'WGS_VDS_PATH' AS variable, root || '/wgs/' || CAST(s AS VARCHAR) || '/hail.vds' AS value FROM based WHERE root IS NOT NULL
  UNION ALL SELECT workspace_id, 'WGS_CRAM_MANIFEST_PATH', root || '/cram/' || CAST(s AS VARCHAR) FROM based WHERE root IS NOT NULL AND s % 2 = 0
  UNION ALL SELECT workspace_id, 'LONG_READS_MANIFEST_PATH', root || '/lr/' || CAST(s AS VARCHAR) FROM based WHERE root IS NOT NULL AND s % 3 = 0
  {" ".join(f"UNION ALL SELECT workspace_id, '{VERSION_PATHS[f]}', root || '/f{i}/' || CAST(s AS VARCHAR) FROM based WHERE root IS NOT NULL AND s % {i % 5 + 2} <> 0" for i, f in _OTHER_PATHS)})"""


@query(
    "config_rows",
    """SELECT 'tier' AS kind, 0 AS position, s_name AS name, 'repo' || CAST(s_suppkey AS VARCHAR) AS place, NULL AS path FROM supplier
       UNION ALL SELECT 'version', 0, s_name || ' a', 'p' || CAST(s_nationkey AS VARCHAR), '/wgs/' || CAST(s_suppkey AS VARCHAR) FROM supplier
       UNION ALL SELECT 'version', 1, s_name || ' b', 'p' || CAST(s_nationkey AS VARCHAR), NULL FROM supplier WHERE s_suppkey % 2 = 0""",
)
def config_rows(spark, sf_dir):
    """Configuration documents, one per supplier, written under the shared folder and read back."""
    key, nothing = F.col("s_suppkey"), F.lit(None).cast("string")

    def version(tail: str, path: Column) -> Column:
        return F.struct(
            F.concat("s_name", F.lit(tail)).alias("name"), F.concat(F.lit("p"), "s_nationkey").alias("bigqueryProject"),
            path.alias("wgsVdsPath"),
        )

    first = F.array(version(" a", F.concat(F.lit("/wgs/"), key)))
    both = F.concat(first, F.array(version(" b", nothing)))
    tier = F.struct(F.col("s_name").alias("shortName"), F.concat(F.lit("repo"), key).alias("artifactRegistryRepo"))
    document = F.struct(
        F.array(tier).alias("accessTiers"), F.when(key % 2 == 0, both).otherwise(first).alias("cdrVersions")
    )
    path = scratch_path(spark, "config")
    table(spark, sf_dir, "supplier").select(F.to_json(document).alias("value")).write.text(path)
    tiers, versions = d.read_config(spark, path, "made", lines=True)
    return tiers.select(
        F.lit("tier").alias("kind"), "position", F.col("shortName").alias("name"),
        F.col("artifactRegistryRepo").alias("place"), nothing.alias("path"),
    ).unionByName(
        versions.select(
            F.lit("version").alias("kind"), "position", "name", F.col("bigqueryProject").alias("place"), F.col("wgsVdsPath").alias("path")
        )
    )


@query("folder_roots", f"WITH {_FOREST_SQL} SELECT id, root_id, status FROM roots")
def folder_roots(spark, sf_dir):
    return v.folder_roots(_folders(spark, sf_dir))


def _workspace_versions(spark, sf_dir):
    folders = _folders(spark, sf_dir)
    return v.workspace_versions(
        _resources(spark, sf_dir), _mapping(spark, sf_dir), _source_resources(spark, sf_dir), folders, v.folder_roots(folders)
    )


@query("lineage_version", f"WITH {_LINEAGE_SQL} SELECT workspace_id, collection_id, version FROM workspace_version")
def lineage_version(spark, sf_dir):
    return _workspace_versions(spark, sf_dir)


def _matched(spark, sf_dir):
    """Versions found for workspaces, with a few collections and versions that do not exist."""
    wanted = _workspace_versions(spark, sf_dir).select(
        "workspace_id",
        F.when(F.col("workspace_id") % 31 == 0, "unknown").otherwise(F.col("collection_id")).alias("collection_id"),
        F.when(F.col("workspace_id") % 29 == 0, "cdrv0").otherwise(F.col("version")).alias("version"),
    )
    return v.match_versions(wanted, _mapping(spark, sf_dir), _tiers(spark, sf_dir), _versions(spark, sf_dir))


@query(
    "version_match",
    f"""WITH {_MATCH_SQL} SELECT workspace_id, collection_id, version, environment, tier, status, 'repo' || CAST(n AS VARCHAR) AS repo,
        'proj-' || CAST(s AS VARCHAR) AS project FROM matched""",
)
def version_match(spark, sf_dir):
    return _matched(spark, sf_dir).select(
        "workspace_id", "collection_id", "version", "environment", "tier", "status",
        F.col("artifactRegistryRepo").alias("repo"), F.col("bigqueryProject").alias("project"),
    )


@query("version_paths", f"WITH {_MATCH_SQL} SELECT * FROM paths")
def version_paths(spark, sf_dir):
    return v.path_variables(_matched(spark, sf_dir).where("status = 'ok'"), ["workspace_id"])


_STATIC_SQL = " ".join(
    f"UNION ALL SELECT workspace_id, '{name}', '{value}' FROM based" for name, value in STATIC_VARIABLES.items()
)


@query(
    "workspace_variables",
    f"""WITH {_MATCH_SQL} SELECT * FROM paths
        UNION ALL SELECT workspace_id, 'WORKSPACE_UFID', 'ws-' || CAST(workspace_id AS VARCHAR) FROM based
        UNION ALL SELECT workspace_id, 'WORKSPACE_BUCKET', 'gs://cloned-mybucket-p' || CAST(workspace_id AS VARCHAR) FROM based
        UNION ALL SELECT workspace_id, 'ARTIFACT_REGISTRY_DOCKER_REPO', 'repo' || CAST(n AS VARCHAR) FROM based
        UNION ALL SELECT workspace_id, 'WORKSPACE_CDR', 'proj-' || CAST(s AS VARCHAR) || '.d' || CAST(s AS VARCHAR) FROM based
        UNION ALL SELECT workspace_id, 'CDR_STORAGE_PATH', root FROM based WHERE root IS NOT NULL {_STATIC_SQL}""",
)
def workspace_variables(spark, sf_dir):
    found = _matched(spark, sf_dir).where("status = 'ok'").select(
        "*",
        F.concat(F.lit("ws-"), "workspace_id").alias("workspace_name"),
        F.concat(F.lit("p"), "workspace_id").alias("project"),
    )
    return v.workspace_variables(found, ["workspace_id"])
