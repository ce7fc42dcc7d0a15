from pathlib import Path

from tallygrove.sources import tables


def test_files_without_rows_count(spark, tmp_path):
    some, none = str(tmp_path / "so me"), str(tmp_path / "none")
    spark.range(5).coalesce(1).write.parquet(some)
    spark.range(0).coalesce(1).write.mode("append").parquet(some)
    spark.range(0).coalesce(1).write.parquet(none)
    found = {r.table_name: r for r in tables.table_sizes({"some": spark.read.parquet(some), "none": spark.read.parquet(none)}).collect()}
    for name, folder, rows in (("some", some, 5), ("none", none, 0)):
        files = list(Path(folder).glob("part-*"))
        r = found[name]
        assert (r.row_count, r.column_count, r.file_count, r.size_bytes) == (rows, 1, len(files), sum(f.stat().st_size for f in files))
        assert r.changed is not None
    assert found["some"].file_count == 2 and found["none"].file_count == 1
