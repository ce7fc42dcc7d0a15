"""Dataset versions: folder roots, lineage, version match, variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENVIRONMENTS, STATIC_VARIABLES, VERSION_PATHS, WORKSPACE_BUCKET_PREFIX
from ..functions.paths import join_paths
from ..session import ensure_checkpoint_dir


def folder_roots(folders: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Root of every folder, with a status: ok, missing_parent or cycle.

    Pointers double in every round, so a tree of depth d takes about log2(d) joins. A round stores only
    the folders that still moved in it; those it settles are stored once, with the round that settled them.
    """
    ensure_checkpoint_dir(folders.sparkSession)
    start = folders.select(F.col(key).alias("id"), F.col(parent).alias("__parent"))
    moving = start.select("id", F.coalesce("__parent", "id").alias("at"), F.when(F.col("__parent").isNull(), "ok").alias("status")).checkpoint()
    settled = [moving.where("status IS NOT NULL")]
    open_before = None
    while True:
        moving = moving.where("status IS NULL")
        open_now = moving.count()
        if open_now == 0:
            break
        if open_now == open_before:
            # A round that settles nothing has only folders on or below a cycle left.
            settled.append(moving.withColumn("status", F.lit("cycle")))
            break
        open_before = open_now
        seen = reduce(DataFrame.unionByName, settled, moving).select(
            F.col("id").alias("at"), F.col("at").alias("__next"), F.col("status").alias("__state"), F.lit(True).alias("__found")
        )
        moving = moving.drop("status").join(seen, "at", "left").select(
            "id",
            F.coalesce("__next", "at").alias("at"),
            F.when(F.col("__found").isNull(), "missing_parent").otherwise(F.col("__state")).alias("status"),
        ).checkpoint()
        settled.append(moving.where("status IS NOT NULL"))
    return reduce(DataFrame.unionByName, settled).select(
        F.col("id").alias(key), F.when(F.col("status") == "ok", F.col("at")).alias("root_id"), "status"
    )


def workspace_versions(
    resources: DataFrame, mapping: DataFrame, source_resources: DataFrame, folders: DataFrame, roots: DataFrame
) -> DataFrame:
    """Collection and version of each workspace: its first lineage entry from a known collection whose root folder resolves.

    The lookup from source resource to root name is built first, so resources take two joins.
    """
    names = folders.select(F.col("id").alias("root_id"), F.col("display_name").alias("version"))
    lookup = (
        source_resources.join(roots.where(F.col("status") == "ok").withColumnRenamed("id", "folder_id"), "folder_id")
        .join(names, "root_id")
        .select(
            F.col("workspace_id").alias("source_workspace"), F.col("resource_id").alias("source_resource"), "version"
        )
    )
    entries = resources.select(
        "workspace_id", "resource_order", F.posexplode("lineage").alias("position", "entry")
    ).select(
        "workspace_id", "resource_order", "position",
        F.col("entry.source_resource").alias("source_resource"),
        F.col("entry.source_workspace").alias("source_workspace"),
    )
    known = entries.join(mapping.select(F.col("collection_id").alias("source_workspace")), "source_workspace", "left_semi")
    return (
        known.join(lookup, ["source_workspace", "source_resource"])
        .groupBy("workspace_id")
        .agg(F.min(F.struct("resource_order", "position", "source_workspace", "version")).alias("first"))
        .select("workspace_id", F.col("first.source_workspace").alias("collection_id"), F.col("first.version").alias("version"))
    )


def match_versions(
    wanted: DataFrame, mapping: DataFrame, tiers: DataFrame, versions: DataFrame,
    environments: tuple[str, ...] = ENVIRONMENTS,
) -> DataFrame:
    """Requests (collection_id, version) with tier and version rows, and a status for the three failures.

    The first tier or version row in file order counts, and the last mapping row of a collection.
    """
    first_tiers = tiers.groupBy("environment", F.col("shortName").alias("tier")).agg(
        F.min_by(F.struct("datasetsBucket", "artifactRegistryRepo"), "position").alias("tier_row")
    )
    version_fields = [c for c in versions.columns if c not in ("environment", "position", "accessTier", "dcVersionName")]
    first_versions = versions.groupBy(
        "environment", F.col("accessTier").alias("tier"), F.col("dcVersionName").alias("version")
    ).agg(F.min_by(F.struct(*version_fields), "position").alias("version_row"))
    known = (
        mapping.groupBy("collection_id")
        .agg(F.max_by(F.struct("environment", "tier"), "position").alias("last"))
        .select("collection_id", "last.environment", "last.tier")
    )
    joined = (
        wanted.join(known, "collection_id", "left")
        .join(first_tiers, ["environment", "tier"], "left")
        .join(first_versions, ["environment", "tier", "version"], "left")
    )
    status = (
        F.when(~F.coalesce(F.col("environment").isin(*environments), F.lit(False)), "unknown_environment")
        .when(F.col("tier_row").isNull(), "tier_not_found")
        .when(F.col("version_row").isNull(), "version_not_found")
        .otherwise("ok")
    )
    return joined.select(
        *wanted.columns, "environment", "tier", status.alias("status"), "tier_row.*", "version_row.*"
    )


def _base_path() -> Column:
    """Bucket and base path joined, or NULL when either is empty."""
    bucket, base = F.nullif("datasetsBucket", F.lit("")), F.nullif("storageBasePath", F.lit(""))
    return F.when(bucket.isNotNull() & base.isNotNull(), join_paths(bucket, base))


def path_variables(versions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per filled path field of a version: variable and whole path."""
    names = F.create_map(*[F.lit(x) for pair in VERSION_PATHS.items() for x in pair])
    based = versions.withColumn("__base", _base_path()).where(F.col("__base").isNotNull())
    fields = [f for f in VERSION_PATHS if f in versions.columns]
    return (
        based.unpivot([*keys, "__base"], fields, "field", "path")
        .where(F.col("path") != "")
        .select(*keys, names[F.col("field")].alias("variable"), join_paths(F.col("__base"), F.col("path")).alias("value"))
    )


def workspace_variables(matched: DataFrame, keys: list[str], bucket_prefix: str = WORKSPACE_BUCKET_PREFIX) -> DataFrame:
    """All variables of workspaces (workspace_name, project) with their matched tier and version, one row each.

    A field that a configuration lacks counts as an empty text, so repository and dataset are always given.
    """
    matched = matched.withColumn("__base", _base_path())
    nothing = F.lit(None).cast("string")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    values = {
        "WORKSPACE_UFID": F.col("workspace_name"),
        "WORKSPACE_BUCKET": F.concat(F.lit(bucket_prefix), F.col("project")),
        "ARTIFACT_REGISTRY_DOCKER_REPO": filled("artifactRegistryRepo"),
        "WORKSPACE_CDR": F.concat(filled("bigqueryProject"), F.lit("."), filled("bigqueryDataset")),
        "CDR_STORAGE_PATH": F.col("__base"),
    }
    pairs = [F.struct(F.lit(n).alias("variable"), v.alias("whole"), nothing.alias("path")) for n, v in values.items()]
    for field, variable in VERSION_PATHS.items():
        if field in matched.columns:
            pairs.append(F.struct(F.lit(variable).alias("variable"), nothing.alias("whole"), F.nullif(F.col(field), F.lit("")).alias("path")))
    pairs += [F.struct(F.lit(n).alias("variable"), F.lit(v).alias("whole"), nothing.alias("path")) for n, v in STATIC_VARIABLES.items()]
    # Paths are joined after the rows are made, by one expression for all fields.
    rows = matched.select(*keys, "__base", F.inline(F.array(*pairs)))
    value = F.coalesce("whole", F.when(F.col("__base").isNotNull() & F.col("path").isNotNull(), join_paths(F.col("__base"), F.col("path"))))
    return rows.select(*keys, "variable", value.alias("value")).where(F.col("value").isNotNull())
