"""Log streams: tailing files, parsing, unit filter, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..constants import (
    CONTAINER_TAG, FLUSH_INTERVAL, SERVICE_TAG, SERVICE_UNITS, STARTUP_TAG, STARTUP_UNITS, TAG_PATTERN,
)

CONTAINER_SCHEMA = "log STRING, stream STRING, time TIMESTAMP"


def tail_files(
    spark: SparkSession, path: str, pattern: str = "*.log", max_length: int | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Lines of new files with the file path kept; over-long lines are skipped when a length is given."""
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("filepath"))
    return lines if max_length is None else lines.where(F.length("line") <= max_length)


def parse_container_lines(lines: DataFrame, schema: StructType | str = CONTAINER_SCHEMA, line: str = "line") -> DataFrame:
    """Fields of container log lines, tagged as such; a line that is not JSON keeps its text and missing fields."""
    parsed = lines.withColumn("__fields", F.from_json(line, schema))
    return parsed.select("*", "__fields.*").drop("__fields").withColumn("tag", F.lit(CONTAINER_TAG))


def keep_units(journal: DataFrame, unit: str = "unit") -> DataFrame:
    """Entries of the named units with the tag of their group."""
    tag = F.when(F.col(unit).isin(*STARTUP_UNITS), STARTUP_TAG).when(F.col(unit).isin(*SERVICE_UNITS), SERVICE_TAG)
    return journal.withColumn("tag", tag).where(F.col("tag").isNotNull())


def routed(entries: DataFrame, pattern: str = TAG_PATTERN) -> DataFrame:
    return entries.where(F.col("tag").like(pattern))


def write_routed(
    entries: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = FLUSH_INTERVAL
) -> StreamingQuery:
    """Write entries with a matching tag to parquet, one folder per tag, at every flush."""
    writer = (
        routed(entries).writeStream.format("parquet").partitionBy("tag")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
