"""Documents made from one small file of parts are spread over tasks, and tables with repeated keys keep their rows."""

from pyspark.sql import functions as F

from tallygrove.operators import catalog
from tallygrove.plans import catalogs
from tallygrove.plans.bind import spread


def _parts(spark, folder, n):
    k = F.col("id")
    spark.range(n).coalesce(1).select(
        k.alias("p_partkey"), F.concat(F.lit("part "), k).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("TYPE").alias("p_type"),
        (k % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"),
    ).write.parquet(f"{folder}/part.parquet")


def test_documents_of_a_small_file_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "_DOCUMENTS_PER_TASK", 1000)
    _parts(spark, tmp_path, 4500)
    texts = catalogs.document_texts(spark, str(tmp_path))
    per_task = [r[1] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 5 and sum(per_task) == 4500 and max(per_task) < 1200
    assert texts.select("path").distinct().count() == 4500


def test_spread_keeps_every_row(spark):
    given = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "k INT, v STRING")
    assert sorted(spread(given, 2, "k").collect(), key=repr) == sorted(given.collect(), key=repr)
    assert spread(given, 2, "k").rdd.getNumPartitions() == 2
    assert spread(given.limit(0), 2, "k").count() == 0


def test_links_are_resolved_without_stored_columns(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(catalogs, "stored", lambda df: kept.append(df.columns) or df)
    _parts(spark, tmp_path, 100)
    links = catalogs.resolved_links(spark, str(tmp_path))
    assert len(kept) == 1 and "columns" not in kept[0] and "link_urls" in kept[0] and links.count() > 10


def test_tables_are_shared_by_name_over_counted_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogs, "_DOCUMENTS_PER_TASK", 200)
    _parts(spark, tmp_path, 4500)
    tables = catalogs.catalog_tables(spark, str(tmp_path))
    per_task = [r[1] for r in tables.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 23 and max(per_task) < 200 and sum(per_task) == tables.select("table_name").distinct().count()


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, tmp_path):
    _parts(spark, tmp_path, 500)
    tables = catalogs.stored(catalogs._tables(spark, str(tmp_path)))
    links = catalog.catalog_links(tables)
    for found in (links, catalog.with_targets(tables, links)):
        plan = found._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
