"""CSV files and object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Quotes are doubled inside quoted fields and blanks are kept, as other CSV tools write them.
_FORM = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, infer: bool = False, multi_line: bool = False
) -> DataFrame:
    """CSV with a header row. With a schema the files are read once; without one all columns are text unless asked.

    An empty field is a missing value. Large files are split between tasks; ``multi_line`` reads files whose
    fields hold line ends, each in one task.
    """
    reader = spark.read.options(**_FORM).option("multiLine", multi_line)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files with a header row each, without an index column or byte-order mark."""
    df.write.mode(mode).options(**_FORM).csv(path)


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All files below a root, optionally by name pattern; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", F.col("length").alias("size_bytes"), "modificationTime")
