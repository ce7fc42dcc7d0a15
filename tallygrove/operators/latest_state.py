"""The latest row per person, kept up to date by batches instead of ranked anew.

The state holds one row per person in buckets by a hash of the person. A batch is cut to its latest rows first, so a hot
person sends one row per task; then the buckets that it touches, and no others, are read, merged and written under the
batch's number. A manifest, one row per bucket, says under which number each bucket stands, and is written last: a batch
that failed half-way left nothing that is read, and one that is handed in again changes nothing. Rows may come in any order.

Persons that are null are one person, as in ``latest_per_person``. A batch without rows moves the number on and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .measurement import latest_per_person


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def newest(spark: SparkSession, path: str) -> int | None:
    """Number of the last batch that is whole in the state, if any is."""
    folder, store = _store(spark, f"{path}/manifest/*/_SUCCESS")
    return max((int(s.getPath().getParent().getName()) for s in store.globStatus(folder) or []), default=None)


def _places(spark: SparkSession, path: str, number: int | None) -> dict[int, int]:
    """Number under which each bucket stands; as many entries as the state has buckets."""
    return {} if number is None else {r["bucket"]: r["number"] for r in spark.read.parquet(f"{path}/manifest/{number}").collect()}


def _rows(spark: SparkSession, path: str, places: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/rows/number={n}/bucket={b}" for b, n in sorted(places.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def apply_batch(path: str, batch: DataFrame, number: int, buckets: int = 256, key: str = "person_id") -> None:
    """Bring the state at ``path`` up to date by a batch; numbers rise, and ``buckets`` is the same for all of them."""
    spark = batch.sparkSession
    last = newest(spark, path)
    if last is not None and last >= number:
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    fresh = stored(latest_per_person(batch, key))
    touched = [r["bucket"] for r in fresh.select(bucket).distinct().collect()]
    places = _places(spark, path, last)
    old = _rows(spark, path, {b: places[b] for b in touched if b in places}, batch.schema)
    if touched:
        # Dealt by bucket once: the rank below needs no shuffle of its own, and a bucket is written by one task.
        both = old.union(fresh).select("*", bucket).repartition("bucket")
        latest_per_person(both, ["bucket", key]).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/number={number}")
    now = [(b, n) for b, n in (places | dict.fromkeys(touched, number)).items()]
    spark.createDataFrame(now, "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The latest row of every person in the state, with the columns of the batches; no rows before the first batch."""
    return _rows(spark, path, _places(spark, path, newest(spark, path)), schema)


def write_latest(stream: DataFrame, path: str, place: str, buckets: int = 256, key: str = "person_id", available_now: bool = False):
    """Keep the state up to date by a stream; a batch repeated after a failure has its number already and changes nothing."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: apply_batch(path, batch, number, buckets, key))
    writer = writer.option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
