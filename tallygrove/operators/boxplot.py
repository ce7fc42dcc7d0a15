"""Box-plot figures by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import WHISKER_REACH
from ..session import stored
from .quantiles import count_values, group_quantiles, quantiles_of_counts

#: Groups whose quartiles, some hundred bytes each, are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 10_000


def box_figures(df: DataFrame, keys: list[str], value: str = "value_as_number", method: str = "approx") -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 interquartile ranges, outlier count, maximum and label.

    ``approx`` takes quartiles from sketches in one pass. ``exact`` counts values once and stores the counts, which
    quartiles and whiskers both read. Quartiles, one row per group, are broadcast after a count of the groups.
    """
    counted = count_values(df, keys, value)
    probs = [0.25, 0.5, 0.75]
    if method == "exact":
        counted = stored(counted)
        found = quantiles_of_counts(counted, probs)
    else:
        found = group_quantiles(df, keys, value, probs, method="approx")
        found = found.select(F.struct(*keys).alias("g") if keys else F.struct(F.lit(0).alias("all")).alias("g"), "quantiles")
    quartiles = stored(found.selectExpr("g", "quantiles[0] AS q1", "quantiles[1] AS median", "quantiles[2] AS q3"))
    if quartiles.count() <= BROADCAST_GROUPS:
        quartiles = F.broadcast(quartiles)
    reach = (F.col("q3") - F.col("q1")) * WHISKER_REACH
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counted.join(quartiles, "g")
        .groupBy("g")
        .agg(
            F.sum("count").alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("count"))), F.lit(0)).alias("outliers"),
            F.max("value").alias("y"),
        )
        .select(
            *[F.col(f"g.{k}").alias(k) for k in keys],
            "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers", "y",
            F.concat(F.lit("N = "), F.col("n").cast("string")).alias("label"),
        )
    )


def group_label(df: DataFrame, keys: list[str], value: str = "value_as_number") -> DataFrame:
    """Position and text of a group's label: maximum and row count."""
    return df.groupBy(*keys).agg(
        F.max(value).alias("y"), F.concat(F.lit("N = "), F.count(F.lit(1)).cast("string")).alias("label")
    )
