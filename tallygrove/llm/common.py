"""Shared expressions: words, text identity, running totals over large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word rule in this subpackage, as characters and as a pattern (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text; none for a blank one."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def digest(*columns: Column) -> Column:
    """128 bits that stand for a sequence of values, as two longs."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("b"), *columns).alias("b"))


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], **values: str) -> DataFrame:
    """Running sums before each row within a group, where a group may hold a third of all rows.

    Rows of a group lie in numbered buckets small enough for one task each; bucket totals, few against
    the rows, are summed first. Output columns are the keys of ``values``, sums of the columns they name.
    """
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(*(F.sum(c).alias(f"_{n}") for n, c in values.items()))
    starts = totals.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col(bucket).alias("_bucket"),
        *(F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in values),
    )
    same = F.col(bucket) == F.col("_bucket")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = df.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in values.items()))
    joined = inner.join(starts, same)
    return joined.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in values))
