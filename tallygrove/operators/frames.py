"""Frame helpers: list columns as text, preview, last lines per source, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..constants import PREVIEW_ROWS, PREVIEW_WIDTH, STATUS_DEFAULT, TAIL_LINES
from ..functions.text import cut_cell


def lists_to_text(df: DataFrame) -> DataFrame:
    """List columns as JSON text; other columns unchanged."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, width: int = PREVIEW_WIDTH, order: list[str] | None = None) -> DataFrame:
    """First rows with long texts cut. Texts are cut after the limit, so only shown rows are touched."""
    shown = (df.orderBy(*order) if order else df).limit(rows)
    return shown.select(
        *[
            cut_cell(F.col(f.name), width).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def preview_note(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Closing line of a preview: a note when rows were left out or there are none, else empty."""
    total = F.col("total_rows")
    note = F.when(total == 0, "(No results)").when(
        total > rows, F.concat(F.lit(f"... showing {rows} of "), total.cast("string"), F.lit(" rows"))
    )
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("note", F.coalesce(note, F.lit("")))


def last_lines(df: DataFrame, key: str, order: list[str], n: int = TAIL_LINES, salts: int = 4096) -> DataFrame:
    """Last n rows per key, latest first by the order columns.

    Up to the session's limit for pushed ranks every task keeps only n rows per key before the shuffle.
    For a larger n a first cut per (key, salt) bounds what the second one gathers; it drops no row of
    the result.
    """
    latest = [F.desc(c) for c in order]

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        ranked = rows.withColumn("line_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*latest)))
        return ranked.where(F.col("line_rank") <= n)

    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        df = cut(salted, key, "__salt").drop("__salt", "line_rank")
    return cut(df, key)


def newest_first(df: DataFrame, created: str = "created_at", tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(created), *([F.desc(tie)] if tie else []))


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def with_status(registry: DataFrame, states: DataFrame, key: str, default: str = STATUS_DEFAULT) -> DataFrame:
    """Every registry row with its live status, or the default when there is none."""
    known = states.select(key, F.col("status").alias("__live"))
    return (
        registry.drop("status").join(known, key, "left")
        .withColumn("status", F.coalesce("__live", F.lit(default)))
        .drop("__live")
    )
