"""Column profile and shape of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, NumericType, ShortType, StringType,
    TimestampNTZType, TimestampType,
)

from ..constants import PROFILE_ROWS
from ..session import stored
from .quantiles import quantiles_of_counts

_PLAIN = (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType)

_IN_DOUBLE = (ByteType, ShortType, IntegerType, FloatType, DoubleType)


def frame_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def first_rows(df: DataFrame, order: list[str] | None = None, rows: int = PROFILE_ROWS) -> DataFrame:
    """The rows the short profile looks at; an order makes them the same ones every time."""
    return (df.orderBy(*order) if order else df).limit(rows)


def _single_pass(df: DataFrame, sketches: bool) -> DataFrame:
    """Figures of all columns from one aggregate row, turned into one row per column."""

    plain = _columns(df)

    def figures(name: str):
        column = F.col(f"`{name}`")
        is_number = plain.get(name, False)
        nothing = F.lit(None).cast("double")
        parts = [
            F.lit(name).alias("column"),
            F.count(column).alias("n"),
            F.count_if(column.isNull()).alias("missing"),
            (F.avg(column).cast("double") if is_number else nothing).alias("mean"),
            (F.stddev(column) if is_number else nothing).alias("stddev"),
            (F.min(column).cast("double") if is_number else nothing).alias("min"),
            (F.max(column).cast("double") if is_number else nothing).alias("max"),
        ]
        if sketches:
            distinct = F.approx_count_distinct(column) if name in plain else F.lit(None).cast("long")
            parts.append(distinct.alias("n_distinct"))
            parts.append(
                F.percentile_approx(column.cast("double"), [0.25, 0.5, 0.75]).alias("quantiles")
                if is_number
                else F.lit(None).cast("array<double>").alias("quantiles")
            )
        return F.struct(*parts)

    row = df.agg(F.array(*[figures(name) for name in df.columns]).alias("columns"))
    return row.select(F.inline("columns"))


def _columns(df: DataFrame) -> dict[str, bool]:
    """Plain columns and whether they hold numbers."""
    return {f.name: isinstance(f.dataType, NumericType) for f in df.schema.fields if isinstance(f.dataType, _PLAIN)}


def column_profile(
    df: DataFrame, method: str = "approx", rows: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """One row per column: counts, distinct values, mean, deviation, least, quartiles, greatest.

    Columns of lists, maps, structures and bytes have counts of values and missing ones only.

    ``approx`` is a single pass that shuffles sketches only. ``exact`` also counts the values of all
    columns as (column, value), which spreads every column over all tasks, and stores the counts.
    ``rows`` gives the short form on the first rows.
    """
    if rows is not None:
        # Stored, so that all figures see the same rows.
        df = stored(first_rows(df, order, rows))
    if method == "approx" or not _columns(df):
        result = _single_pass(df, sketches=True)
    else:
        columns = _columns(df)
        exact = {f.name for f in df.schema.fields if isinstance(f.dataType, _IN_DOUBLE)}
        cells = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    # Numbers that a double holds exactly need no text to be told apart.
                    (F.lit(None) if name in exact else F.col(name)).cast("string").alias("text"),
                    (F.col(name) if number else F.lit(None)).cast("double").alias("value"),
                )
                for name, number in columns.items()
            ]
        )
        distinct = (
            df.select(F.inline(cells))
            .where(F.col("text").isNotNull() | F.col("value").isNotNull())
            .groupBy(F.struct("column").alias("g"), "text", "value")
            .agg(F.count(F.lit(1)).alias("count"))
        )
        distinct = stored(distinct)
        n_distinct = distinct.groupBy("g.column").agg(F.count(F.lit(1)).alias("n_distinct"))
        counted = distinct.where(F.col("value").isNotNull()).select("g", "value", "count")
        quartiles = quantiles_of_counts(counted, [0.25, 0.5, 0.75]).select("g.column", "quantiles")
        result = _single_pass(df, sketches=False).join(n_distinct, "column", "left").join(quartiles, "column", "left")
        counted_columns = F.col("column").isin(list(columns))
        result = result.withColumn("n_distinct", F.when(counted_columns, F.coalesce("n_distinct", F.lit(0))))
    return result.select(
        "column", "n", "missing",
        "n_distinct",
        "mean", "stddev", "min",
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
        "max",
    )
