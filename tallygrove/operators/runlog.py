"""Query runs: one checked run, retries through a caller's repair function, and reports over run logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType,
    StructType, TimestampNTZType, TimestampType,
)

from ..constants import LARGE_RESULT, MAX_RETRIES
from ..functions.paths import megabytes
from ..functions.text import clean_error
from ..sources.tables import sql_with

RUN_SCHEMA = (
    "query_id STRING, attempt INT, sql STRING, checked BOOLEAN, estimated_bytes DECIMAL(38,0), success BOOLEAN, error STRING, row_count BIGINT, "
    "result_bytes BIGINT"
)


#: Bytes of values of a fixed width.
_WIDTHS = {BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, FloatType: 4, DateType: 4, LongType: 8, DoubleType: 8, TimestampType: 8, TimestampNTZType: 8}


def _consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


@dataclass
class QueryRun:
    """Outcome of a run: the lazy result, if any, and one record per attempt."""

    frame: DataFrame | None
    records: list[tuple] = field(default_factory=list)

    def log(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.records, RUN_SCHEMA)
        return with_large_flag(rows.withColumn("error", clean_error(F.col("error"))))


def estimated_bytes(frame: DataFrame) -> Decimal:
    """The planner's estimate of a result's size."""
    return Decimal(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def value_bytes(column: Column, kind: DataType) -> Column:
    """Bytes of a value: its width, or the length of its text; a missing value has none."""
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        size = F.octet_length(F.to_json(column))
    elif isinstance(kind, tuple(_WIDTHS)):
        size = F.lit(next(w for t, w in _WIDTHS.items() if isinstance(kind, t)))
    else:
        size = F.octet_length(column.cast("string"))
    return F.when(column.isNotNull(), size).otherwise(0).cast("long")


def observed(frame: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame, which counts its rows and their bytes as ``n_rows`` and ``n_bytes`` while whatever is done with it runs."""
    seen = Observation()
    size = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields), F.lit(0).cast("long"))
    return frame.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")), seen


def run_query(
    spark: SparkSession,
    sql: str,
    query_id: str = "query",
    repair: Callable[[str, str], str | None] | None = None,
    max_retries: int = MAX_RETRIES,
    args: dict | None = None,
    write: Callable[[DataFrame], None] | None = None,
) -> QueryRun:
    """Check and run one statement; the driver sees its row count only.

    Analysis is the check without running; a text that passes it is ``checked`` and has the planner's
    estimate of the bytes of its result. A failed text goes to ``repair(sql, error)`` for a new text
    until it works, the repairs run out or give none.

    With ``write``, which does what the caller wants with the result, that is the run: rows and bytes are observed on
    the way, and the statement is not run a second time. ``write`` may be called again with a repaired text's result,
    so it should overwrite. Without it rows and bytes are counted by a run of their own.
    """
    records: list[tuple] = []
    for attempt in range(1, max_retries + 2):
        checked, size = False, None
        try:
            frame = sql_with(spark, sql, **(args or {}))
            checked, size = True, estimated_bytes(frame)
            counted, seen = observed(frame)
            (write or _consume)(counted)
            found = seen.get
            records.append((query_id, attempt, sql, checked, size, True, None, found["n_rows"], found["n_bytes"]))
            return QueryRun(frame, records)
        except PySparkException as problem:
            message = str(problem)
            records.append((query_id, attempt, sql, checked, size, False, message, None, None))
            fixed = repair(sql, message) if repair and attempt <= max_retries else None
            if not fixed:
                break
            sql = fixed
    return QueryRun(None, records)


def with_large_flag(runs: DataFrame, rows: str = "row_count") -> DataFrame:
    return runs.withColumn("is_large", F.coalesce(F.col(rows) > LARGE_RESULT, F.lit(False)))


def with_megabytes(runs: DataFrame, size: str = "bytes") -> DataFrame:
    return runs.withColumn("megabytes", megabytes(F.col(size)))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Per query: attempts made, final outcome, final text, first and last error.

    All attempts of a log count, however many; the limit on retries belongs to ``run_query``. All
    figures combine before the shuffle.
    """
    error = F.when(~F.col("success"), clean_error(F.col("error")))
    return (
        attempts.groupBy("query_id")
        .agg(
            F.max("attempt").alias("attempts"),
            F.max_by("success", "attempt").alias("success"),
            F.max_by("sql", "attempt").alias("final_sql"),
            F.min_by(error, F.when(error.isNotNull(), F.col("attempt"))).alias("first_error"),
            F.max_by(error, F.when(error.isNotNull(), F.col("attempt"))).alias("last_error"),
        )
    )
