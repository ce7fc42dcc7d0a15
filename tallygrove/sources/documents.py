"""Table description documents and configuration files in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import VERSION_PATHS
from ..functions.once import once

DOCUMENT_SCHEMA = """
resourceType STRING, id STRING, url STRING, title STRING, description STRING, purpose STRING,
extension ARRAY<STRUCT<url: STRING, valueString: STRING, valueCanonical: STRING, valueCode: STRING,
  extension: ARRAY<STRUCT<url: STRING, valueString: STRING>>>>,
meta STRUCT<security: ARRAY<STRUCT<system: STRING, display: STRING>>>,
contact ARRAY<STRUCT<name: STRING>>,
useContext ARRAY<STRUCT<code: STRUCT<code: STRING>,
  valueCodeableConcept: STRUCT<coding: ARRAY<STRUCT<display: STRING>>>, valueQuantity: STRUCT<value: DOUBLE>>>,
differential STRUCT<element: ARRAY<STRUCT<path: STRING, min: INT, short: STRING, definition: STRING, comment: STRING,
  type: ARRAY<STRUCT<code: STRING>>,
  binding: STRUCT<description: STRING, valueSet: STRING, strength: STRING>,
  mapping: ARRAY<STRUCT<identity: STRING, map: STRING, comment: STRING>>,
  extension: ARRAY<STRUCT<url: STRING, valueCoding: STRUCT<system: STRING, code: STRING>,
    extension: ARRAY<STRUCT<url: STRING,
      valueCodeableConcept: STRUCT<text: STRING, coding: ARRAY<STRUCT<display: STRING>>>>>>>>>>
"""

CONFIG_SCHEMA = (
    "accessTiers ARRAY<STRUCT<shortName: STRING, datasetsBucket: STRING, artifactRegistryRepo: STRING>>, "
    "cdrVersions ARRAY<STRUCT<name: STRING, accessTier: STRING, bigqueryProject: STRING, bigqueryDataset: STRING, "
    "dcVersionName: STRING, storageBasePath: STRING, " + ", ".join(f"{p}: STRING" for p in VERSION_PATHS) + ">>"
)

MAPPING_SCHEMA = "dataCollectionUuid STRING, cdrEnv STRING, accessTier STRING"


def read_documents(
    spark: SparkSession, path: str, recursive: bool = True, lines: bool = False, pattern: str = "*.json"
) -> DataFrame:
    """JSON documents below a folder, local or remote, with their file path; unreadable ones are skipped.

    ``lines`` reads files that hold one document per line and can be split between tasks; the place within
    the file then follows the path, so that a later line of a file also sorts later.
    """
    schema = DOCUMENT_SCHEMA + ", _corrupt_record STRING"
    found = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", pattern)
        .option("mode", "PERMISSIVE")
        .json(path)
    )
    # The path column keeps the parser reading whole documents, so the broken-record mark is always set.
    path_column = F.col("_metadata.file_path")
    if lines:
        # Blocks of a file in order, and rows of a block in the order they are read.
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        path_column = F.format_string("%s#%020d#%020d", path_column, F.col("_metadata.file_block_start"), row)
    located = found.select("*", path_column.alias("doc_path"))
    return located.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def parse_documents(texts: DataFrame, text: str, path: str) -> DataFrame:
    """The same from a column of JSON texts and a column that orders them."""
    schema = DOCUMENT_SCHEMA + ", _corrupt_record STRING"
    parsed = once(
        texts.select(F.col(text).alias("__text"), F.col(path).alias("doc_path")),
        doc=F.from_json("__text", schema, {"mode": "PERMISSIVE"}),
    )
    kept = parsed.where(F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull())
    return kept.select("doc.*", "doc_path").drop("_corrupt_record")


def read_config(
    spark: SparkSession, path: str, environment: str, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Access tiers and versions of one environment's configuration, in file order; ``lines`` as for documents."""
    config = spark.read.schema(CONFIG_SCHEMA).option("multiLine", not lines).json(path)

    def rows(name: str) -> DataFrame:
        return config.select(F.posexplode(name).alias("position", "item")).select(
            F.lit(environment).alias("environment"), "position", "item.*"
        )

    return rows("accessTiers"), rows("cdrVersions")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Collection mapping rows, a JSON array of objects, with their ``position`` in the file."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{MAPPING_SCHEMA.replace(' STRING', ': STRING')}>>")).alias("position", "row")).select("row.*", "position")
