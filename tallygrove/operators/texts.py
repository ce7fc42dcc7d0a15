"""Text operators over whole tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.once import named
from ..functions.text import csv_table, pipe_table, sql_block


def extract_sql(texts: DataFrame, text: str, name: str = "sql") -> DataFrame:
    return texts.withColumn(name, sql_block(F.col(text)))


def table_cells(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Cells of the table in each text, one row per (row, column): a pipe table, else CSV after the row-count line.

    A pipe table runs from its first row to the next blank line; rows whose cell count differs from the
    header's fall out. A CSV part with a record longer than its header is no table; a shorter record is
    filled with missing values. Each text is taken apart in its own row, so nothing is shuffled.
    """
    source = F.col(text)
    start = texts.where(source.contains("|") | source.contains("rows returned"))
    # The CSV part is only looked for in texts without a pipe table.
    found = named(pipe_table(source), lambda t: F.when(F.size(t) > 1, t).otherwise(csv_table(source)))
    rows = named(
        found,
        lambda t: F.transform(
            F.slice(t, F.lit(2), F.size(t)), lambda r: F.struct(F.get(t, F.lit(0)).alias("head"), r.alias("cells"))
        ),
    )
    # Not exploding to nothing: that would bring in filters that work the whole expression out again.
    listed = start.select(*keys, F.posexplode_outer(rows).alias("row_no", "r")).where(F.col("row_no").isNotNull())
    pairs = F.arrays_zip(F.col("r.head").alias("name"), F.col("r.cells").alias("value"))
    cells = listed.select(*keys, "row_no", F.posexplode_outer(pairs).alias("column_no", "c"))
    return cells.where(F.col("column_no").isNotNull()).select(
        *keys, "row_no", "column_no", F.col("c.name").alias("column_name"), F.col("c.value").alias("value")
    )
