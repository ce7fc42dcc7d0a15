"""Activity marks, last activity and idle machines; the same functions serve batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import ACTIVITY_KINDS, FORWARD_TEXT, FORWARD_TIME_FORMAT, LOAD_THRESHOLD, MARKS_LATE


def proxy_marks(lines: DataFrame, line: str = "line", key: str = "machine") -> DataFrame:
    """Times of forwarded requests in proxy log lines, as activity marks."""
    stamp = F.regexp_extract(line, r"^\s*(\S+\s+\S+)", 1)
    return lines.where(F.col(line).contains(FORWARD_TEXT)).select(
        key, F.lit("proxy").alias("kind"),
        F.try_to_timestamp(F.regexp_replace(stamp, r"\s+", " "), F.lit(FORWARD_TIME_FORMAT)).alias("at"),
    ).where(F.col("at").isNotNull())


def load_marks(samples: DataFrame, threshold: float = LOAD_THRESHOLD, key: str = "machine") -> DataFrame:
    """Samples whose load reaches the threshold, as activity marks."""
    return samples.where(F.col("load") >= threshold).select(key, F.lit("cpu").alias("kind"), "at")


def last_activity(marks: DataFrame, key: str = "machine") -> DataFrame:
    """Latest time of each kind and the latest of all, per machine.

    Four maxima per machine are all the state; late and repeated marks change nothing.
    """
    latest = marks.where(F.col("kind").isin(*ACTIVITY_KINDS)).groupBy(key).agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("at"))).alias(f"last_{kind}") for kind in ACTIVITY_KINDS]
    )
    return latest.withColumn("last_active", F.greatest(*[F.col(f"last_{kind}") for kind in ACTIVITY_KINDS]))


def idle_flag(as_of: Column, last_active: Column, timeout: Column) -> Column:
    """Idle when the time since the last activity exceeds the timeout in seconds; no timeout or 0 means never."""
    waited = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(last_active.cast("timestamp"))
    return F.coalesce((timeout > 0) & (waited > timeout), F.lit(False))


def idle_machines(activity: DataFrame, as_of: Column, timeout_seconds: int | Column | None) -> DataFrame:
    timeout = timeout_seconds if isinstance(timeout_seconds, Column) else F.lit(timeout_seconds).cast("long")
    return activity.withColumn("is_idle", idle_flag(as_of, F.col("last_active"), timeout))


def _saver(path: str, compact_every: int, merge: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writes a batch to a folder of its own; a repeated batch overwrites itself.

    Every ``compact_every`` batches the batch's folder takes in all older ones, which then go. If such a batch is
    repeated after its folder was written in full, only the clearing is done again.
    """

    def save(changed: DataFrame, batch: int) -> None:
        spark, own = changed.sparkSession, f"batch={batch}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [f.getPath() for f in store.listStatus(folder)] if store.exists(folder) else []
        older = [p for p in there if p.getName().startswith("batch=") and p.getName() != own]
        if batch % compact_every != compact_every - 1 or not older:
            changed.write.mode("overwrite").parquet(f"{path}/{own}")
            return
        if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{own}/_SUCCESS")):
            saved = spark.read.schema(changed.schema).parquet(*[p.toString() for p in older])
            merge(saved.unionByName(changed), changed.columns[0]).write.mode("overwrite").parquet(f"{path}/{own}")
        for p in older:
            store.delete(p, True)

    return save


def write_last_activity(
    marks: DataFrame, path: str, checkpoint: str, available_now: bool = False, compact_every: int = 50
) -> StreamingQuery:
    """Write the machines that changed in each batch; ``merge_activity`` reads them. The state is four times per machine, for ever."""
    save = _saver(path, compact_every, merge_activity)
    writer = last_activity(marks).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_activity(saved: DataFrame, key: str = "machine") -> DataFrame:
    """One row per machine out of the saved batches: activity only moves forward, so maxima merge them."""
    kinds = [f"last_{kind}" for kind in ACTIVITY_KINDS]
    return saved.groupBy(key).agg(*[F.max(c).alias(c) for c in [*kinds, "last_active"]])


def _timed(marks: DataFrame) -> DataFrame:
    """Watermarks are over times with a zone; times without one are taken in the session's."""
    return marks.withColumn("at", F.col("at").cast("timestamp"))


def fresh_marks(marks: DataFrame, late: str = MARKS_LATE, key: str = "machine") -> DataFrame:
    """Marks of a stream, each once: what is delivered again within the watermark is dropped, and so is what comes after it.

    A mark is kept as state only until the watermark, ``late`` behind the latest time seen, has passed its time by ``late``.
    """
    return _timed(marks).withWatermark("at", late).dropDuplicatesWithinWatermark([key, "kind", "at"])


def recent_activity(marks: DataFrame, key: str = "machine") -> DataFrame:
    """Last activity and number of marks per machine, out of marks that are there once."""
    counts = marks.where(F.col("kind").isin(*ACTIVITY_KINDS)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_marks"), *[F.max(F.when(F.col("kind") == kind, F.col("at"))).alias(f"last_{kind}") for kind in ACTIVITY_KINDS]
    )
    return counts.withColumn("last_active", F.greatest(*[F.col(f"last_{kind}") for kind in ACTIVITY_KINDS]))


def merge_recent(saved: DataFrame, key: str = "machine") -> DataFrame:
    """One row per machine out of the saved batches: times by maxima, numbers by sums, as every mark is in one batch."""
    times = [*[f"last_{kind}" for kind in ACTIVITY_KINDS], "last_active"]
    return saved.groupBy(key).agg(F.sum("n_marks").alias("n_marks"), *[F.max(c).alias(c) for c in times])


def write_recent_activity(
    marks: DataFrame, path: str, checkpoint: str, late: str = MARKS_LATE, key: str = "machine", available_now: bool = False, compact_every: int = 50
) -> StreamingQuery:
    """Last activity of a stream with bounded state: fresh marks are all it keeps, batches are condensed each by itself.

    Machines that fell silent hold no state, and a batch that is repeated after a failure overwrites its own folder.
    """
    save = _saver(path, compact_every, merge_recent)

    def condense(batch: DataFrame, number: int) -> None:
        save(recent_activity(batch, key), number)

    writer = fresh_marks(marks, late, key).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(condense)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity_sessions(marks: DataFrame, timeout_seconds: int, key: str = "machine") -> DataFrame:
    """Stretches of activity per machine, from ``active_from`` to ``active_until``: marks at most the timeout apart, and their number.

    Marks within one timeout's length on the clock belong together in any case and are combined before sessions are
    formed, so that a busy machine brings at most one row per such length, however many marks it has.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    short = marks.where(F.col("at").isNotNull()).groupBy(key, F.floor(micros / F.lit(timeout_seconds * 1_000_000)).alias("__part")).agg(
        F.min("at").alias("__first"), F.max("at").alias("__last"), F.count(F.lit(1)).alias("__n"))
    span = F.unix_micros(F.col("__last").cast("timestamp")) - F.unix_micros(F.col("__first").cast("timestamp")) + F.lit(timeout_seconds * 1_000_000)
    return short.groupBy(key, F.session_window("__first", F.concat(span.cast("string"), F.lit(" microseconds")))).agg(
        F.min("__first").alias("active_from"), F.max("__last").alias("active_until"), F.sum("__n").alias("n_marks")
    ).drop("session_window")


def idle_gaps(marks: DataFrame, timeout_seconds: int, key: str = "machine", until: Column | None = None) -> DataFrame:
    """Times when a machine was idle: from a mark to the next, where they are more than the timeout apart.

    With ``until``, the time since a machine's last mark counts too, where it exceeds the timeout by then.
    """
    sessions = activity_sessions(marks, timeout_seconds, key)
    later = F.lead("active_from").over(Window.partitionBy(key).orderBy("active_from"))
    gaps = sessions.select(key, F.col("active_until").alias("idle_from"), (F.coalesce(later, until) if until is not None else later).alias("idle_until"))
    waited = F.unix_micros(F.col("idle_until").cast("timestamp")) - F.unix_micros(F.col("idle_from").cast("timestamp"))
    return gaps.withColumn("idle_seconds", waited / 1_000_000).where(F.col("idle_seconds") > timeout_seconds)


def closed_sessions(marks: DataFrame, timeout_seconds: int, late: str = MARKS_LATE, key: str = "machine") -> DataFrame:
    """Sessions of a stream that no mark can continue any more: the watermark has passed their last mark by the timeout.

    In append mode a session comes out when it closes, so that a machine is reported idle without a new mark of its own; its
    state goes then. Only machines active of late are held.
    """
    window = F.session_window("at", f"{timeout_seconds} seconds")
    return _timed(marks).withWatermark("at", late).groupBy(key, window).agg(
        F.min("at").alias("active_from"), F.max("at").alias("active_until"), F.count(F.lit(1)).alias("n_marks")
    ).drop("session_window")


def write_closed_sessions(
    marks: DataFrame, path: str, checkpoint: str, timeout_seconds: int, late: str = MARKS_LATE, key: str = "machine", available_now: bool = False
) -> StreamingQuery:
    writer = closed_sessions(marks, timeout_seconds, late, key).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def idle_by_sessions(activity: DataFrame, closed: DataFrame, key: str = "machine") -> DataFrame:
    """Machines with ``is_idle``: the session of their last mark has closed."""
    last = closed.groupBy(F.col(key).alias("__key")).agg(F.max("active_until").alias("__until"))
    met = activity.join(last, F.col(key).eqNullSafe(F.col("__key")), "left")
    return met.withColumn("is_idle", F.coalesce(F.col("__until") >= F.col("last_active"), F.lit(False))).drop("__key", "__until")
