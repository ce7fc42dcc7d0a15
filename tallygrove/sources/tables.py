"""Warehouse tables: reading, listings and column lists."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMN_SCHEMA = "position INT, column_name STRING, data_type STRING, is_nullable BOOLEAN, description STRING"
_TABLE_SCHEMA = "priority INT, project STRING, dataset STRING, table_name STRING, table_type STRING"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalogue table by its one- to three-part name, or a parquet path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def sql_with(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Run SQL with named parameters (``:name``) and frames (``{name}``); no view of the session is touched."""
    frames = {k: v for k, v in args.items() if isinstance(v, DataFrame)}
    return spark.sql(sql, args={k: v for k, v in args.items() if k not in frames}, **frames)


def name_parts(name: str) -> list[str] | None:
    """Parts of a two- or three-part table name, else None."""
    parts = name.replace("`", "").split(".")
    return parts if len(parts) in (2, 3) else None


def columns_of(df: DataFrame) -> DataFrame:
    """Columns in position order; the driver handles the schema only."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment"))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, _COLUMN_SCHEMA).orderBy("position")


def table_columns(spark: SparkSession, name: str) -> DataFrame | None:
    """Column list of a two- or three-part table name; None for other names or a table that is not there."""
    parts = name_parts(name)
    if parts is None:
        return None
    try:
        return columns_of(spark.table(".".join(f"`{p}`" for p in parts)))
    except PySparkException:
        return None


def list_tables(spark: SparkSession, projects: list[str] | None = None) -> DataFrame:
    """Tables of all datasets of several catalogues, in the order of the projects; one that cannot be listed is skipped."""
    rows = []
    for priority, project in enumerate(projects or [spark.catalog.currentCatalog()]):
        try:
            datasets = [r.namespace for r in spark.sql(f"SHOW NAMESPACES IN `{project}`").collect()]
        except PySparkException:
            continue
        for dataset in datasets:
            try:
                found = spark.catalog.listTables(f"`{project}`.`{dataset}`")
            except PySparkException:
                continue
            rows += [(priority, project, dataset, t.name, t.tableType) for t in found if not t.isTemporary]
    return spark.createDataFrame(rows, _TABLE_SCHEMA)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, files, bytes and latest change of named tables that lie in files, ordered by name; files without rows count as well."""

    def facts(name: str, df: DataFrame) -> DataFrame:
        rows = df.agg(F.count(F.lit(1)).alias("row_count"))
        # The listing has files without rows as well; contents are not read.
        if paths := [unquote(p) for p in df.inputFiles()]:
            listed = df.sparkSession.read.format("binaryFile").load(paths).select("length", "modificationTime")
        else:
            listed = df.sparkSession.createDataFrame([], "length LONG, modificationTime TIMESTAMP")
        files = listed.agg(
            F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"), F.max("modificationTime").alias("changed")
        )
        # One row each, whose columns the other lacks.
        return rows.unionByName(files, allowMissingColumns=True).agg(
            F.lit(name).alias("table_name"),
            F.max("row_count").alias("row_count"),
            F.lit(len(df.columns)).cast("long").alias("column_count"),
            *(F.max(c).alias(c) for c in ("file_count", "size_bytes", "changed")),
        )

    counts = [facts(name, df) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def dataset_tables(spark: SparkSession, dataset: str, count_rows: bool = False) -> DataFrame | None:
    """Tables of a one- or two-part dataset name with type, bytes and times, ordered by name.

    Rows and bytes come from the catalogue's statistics, where it has any; ``count_rows`` counts instead.
    """
    parts = dataset.replace("`", "").split(".")
    if len(parts) > 2:
        return None
    scope = ".".join(f"`{p}`" for p in parts)
    try:
        names = [t for t in spark.catalog.listTables(scope) if not t.isTemporary]
    except PySparkException:
        return None
    schema = "table_name STRING, table_type STRING, size_bytes BIGINT, row_count BIGINT, created STRING"
    rows = []
    for t in names:
        facts = {
            r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {scope}.`{t.name}`").collect()
        }
        size = re.match(r"(\d+) bytes(?:, (\d+) rows)?", facts.get("Statistics") or "")
        known = [int(x) if x else None for x in size.groups()] if size else [None, None]
        rows.append((t.name, t.tableType, *known, facts.get("Created Time")))
    listed = spark.createDataFrame(rows, schema)
    if not names or not count_rows:
        return listed.orderBy("table_name")
    counts = table_sizes({t.name: spark.table(f"{scope}.`{t.name}`") for t in names})
    counts = counts.select("table_name", "size_bytes", "row_count")
    return listed.drop("size_bytes", "row_count").join(counts, "table_name").orderBy("table_name")
