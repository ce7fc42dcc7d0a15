"""CSV and file listings through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files as s
from . import query
from .bind import as_text, table


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    """Orders written as CSV with a header and read back with a schema."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-csv")
    s.write_csv(orders, path)
    return as_text(s.read_csv(spark, path, orders.schema), "o_orderdate")


@query(
    "csv_texts",
    "SELECT doc_id, md5(text) AS text_md5, lang FROM documents",
)
def csv_texts(spark, sf_dir):
    """Whole texts with commas, quotes and line ends survive the way through CSV."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "texts-csv")
    s.write_csv(texts, path)
    return s.read_csv(spark, path, texts.schema, multi_line=True).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("csv_listing", "SELECT o_orderstatus AS part, true AS has_data FROM orders GROUP BY o_orderstatus")
def csv_listing(spark, sf_dir):
    """Files of a partitioned CSV export found by pattern below its root; file names are left to the writer."""
    path = scratch_path(spark, "orders-parts")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).partitionBy("o_orderstatus").csv(path)
    found = s.list_files(spark, path, "*.csv")
    return found.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1).alias("part")).agg(
        (F.sum("size_bytes") > 0).alias("has_data")
    )
