"""Stream jobs over the events table as a file stream, run to the end of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SERVICE_UNITS, STARTUP_UNITS
from ..session import scratch_path
from ..streaming import activity as a
from ..streaming import logs as g
from . import query
from .bind import event_number, table

_UNITS = [*STARTUP_UNITS, *SERVICE_UNITS, "cron.service", "sshd.service"]


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _journal(events: DataFrame) -> DataFrame:
    """Journal entries: the unit follows from the user, the line from the event."""
    unit = F.get(F.array(*[F.lit(u) for u in _UNITS]), (F.col("user_id") % len(_UNITS)).cast("int"))
    return events.select(
        "event_id", unit.alias("unit"), F.concat("event_type", F.lit(" "), F.col("user_id")).alias("line")
    )


_UNIT_LIST = "[" + ", ".join(f"'{u}'" for u in _UNITS) + "]"
_JOURNAL_SQL = f"""journal AS (
  SELECT event_id, ({_UNIT_LIST})[CAST(user_id % {len(_UNITS)} + 1 AS BIGINT)] AS unit, event_type || ' ' || CAST(user_id AS VARCHAR) AS line FROM events),
tagged AS (
  SELECT *, CASE WHEN unit IN ({", ".join(f"'{u}'" for u in STARTUP_UNITS)}) THEN 'vm-journald-startup-logs'
                 WHEN unit IN ({", ".join(f"'{u}'" for u in SERVICE_UNITS)}) THEN 'vm-journald-logs' END AS tag FROM journal)"""


def _finish(job) -> None:
    job.awaitTermination()
    if job.exception():
        raise job.exception()


@query("stream_route", f"WITH {_JOURNAL_SQL} SELECT event_id, unit, line, tag FROM tagged WHERE tag IS NOT NULL")
def stream_route(spark, sf_dir):
    out, marks = scratch_path(spark, "routed"), scratch_path(spark, "routed-marks")
    entries = g.keep_units(_journal(_event_stream(spark, sf_dir)))
    _finish(g.write_routed(entries, out, marks, available_now=True))
    return spark.read.schema("event_id BIGINT, unit STRING, line STRING, tag STRING").parquet(out)


@query("journal_units", f"WITH {_JOURNAL_SQL} SELECT unit, tag, count(*) AS n FROM tagged WHERE tag LIKE 'vm-%' GROUP BY unit, tag")
def journal_units(spark, sf_dir):
    kept = g.routed(g.keep_units(_journal(table(spark, sf_dir, "events"))))
    return kept.groupBy("unit", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "container_lines",
    """SELECT event_id, event_type || ' "' || CAST(user_id AS VARCHAR) || '"' AS log, 'stdout' AS stream, 'vm-docker-logs' AS tag FROM events""",
)
def container_lines(spark, sf_dir):
    """Container lines written as log files, tailed by a stream and parsed."""
    source, out, marks = (scratch_path(spark, n) for n in ("containers", "parsed", "parsed-marks"))
    log = F.concat("event_type", F.lit(' "'), F.col("user_id"), F.lit('"'))
    line = F.to_json(F.struct(log.alias("log"), F.lit("stdout").alias("stream"), F.col("ts").alias("time"), "event_id"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(source)
    lines = g.tail_files(spark, source, pattern="*.txt")
    parsed = g.parse_container_lines(lines, g.CONTAINER_SCHEMA + ", event_id BIGINT")
    _finish(g.write_routed(parsed.drop("line"), out, marks, available_now=True))
    read = spark.read.schema("event_id BIGINT, log STRING, stream STRING, filepath STRING, tag STRING").parquet(out)
    return read.where(F.col("filepath").isNotNull()).drop("filepath")


_MARKS_SQL = """marks AS (
  SELECT user_id AS machine, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'proxy' WHEN 'purchase' THEN 'ssh'
         WHEN 'signup' THEN 'boot' END AS kind, ts FROM events),
activity AS (
  SELECT machine, max(ts) FILTER (kind = 'cpu') AS last_cpu, max(ts) FILTER (kind = 'proxy') AS last_proxy,
         max(ts) FILTER (kind = 'ssh') AS last_ssh, max(ts) FILTER (kind = 'boot') AS last_boot, max(ts) AS last_active
  FROM marks WHERE kind IS NOT NULL GROUP BY machine)"""


def _marks(events: DataFrame) -> DataFrame:
    kinds = {"click": "cpu", "view": "proxy", "purchase": "ssh", "signup": "boot"}
    words = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return events.select(F.col("user_id").alias("machine"), words[F.col("event_type")].alias("kind"), F.col("ts").alias("at"))


_TIMES = ("last_cpu", "last_proxy", "last_ssh", "last_boot", "last_active")
_TIMES_SQL = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in _TIMES)


def _timed(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in _TIMES else F.col(c) for c in df.columns]
    )


@query("last_activity", f"WITH {_MARKS_SQL} SELECT machine, {_TIMES_SQL} FROM activity")
def last_activity(spark, sf_dir):
    return _timed(a.last_activity(_marks(table(spark, sf_dir, "events"))))


@query("last_activity_stream", f"WITH {_MARKS_SQL} SELECT machine, {_TIMES_SQL} FROM activity")
def last_activity_stream(spark, sf_dir):
    out, marks = scratch_path(spark, "activity"), scratch_path(spark, "activity-marks")
    _finish(a.write_last_activity(_marks(_event_stream(spark, sf_dir)), out, marks, available_now=True))
    return _timed(a.merge_activity(spark.read.parquet(out)))


@query(
    "idle_flags",
    f"""WITH {_MARKS_SQL} SELECT machine, CASE WHEN machine % 3 = 0 THEN 0 WHEN machine % 3 = 1 THEN 21600 END AS timeout,
        coalesce(machine % 3 = 1 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last_active)) > 21600, false) AS is_idle FROM activity""",
)
def idle_flags(spark, sf_dir):
    """Six hours for a third of the machines, 0 and none for the others."""
    timeout = F.when(F.col("machine") % 3 == 0, 0).when(F.col("machine") % 3 == 1, 21600)
    activity = a.last_activity(_marks(table(spark, sf_dir, "events"))).withColumn("timeout", timeout)
    flagged = a.idle_machines(activity, F.lit("2024-01-31 00:00:00").cast("timestamp"), F.col("timeout"))
    return flagged.select("machine", "timeout", "is_idle")


@query(
    "activity_marks",
    f"""WITH loads AS (SELECT user_id AS machine, ts, regexp_extract(props, '(\\d+)', 1) AS k, event_type FROM events)
        SELECT machine, 'proxy' AS kind, count(*) AS n, strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS latest
        FROM loads WHERE event_type = 'view' GROUP BY machine
        UNION ALL
        SELECT machine, 'cpu', count(*), strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM loads WHERE CAST(k AS INTEGER) >= 10 GROUP BY machine""",
)
def activity_marks(spark, sf_dir):
    """Marks out of proxy log lines and load samples."""
    events = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    text = F.when(F.col("event_type") == "view", F.lit(" Forwarded request to backend")).otherwise(" Health check")
    lines = events.select(F.col("user_id").alias("machine"), F.concat(stamp, text).alias("line"))
    samples = events.select(F.col("user_id").alias("machine"), (event_number() / 100).alias("load"), F.col("ts").alias("at"))
    found = a.proxy_marks(lines).unionByName(a.load_marks(samples))
    return found.groupBy("machine", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("latest")
    )


@query(
    "recent_activity_stream",
    f"""WITH {_MARKS_SQL}, counted AS (SELECT machine, count(DISTINCT kind || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS n_marks FROM marks WHERE kind IS NOT NULL GROUP BY machine)
        SELECT machine, n_marks, {_TIMES_SQL} FROM activity JOIN counted USING (machine)""",
)
def recent_activity_stream(spark, sf_dir):
    """Every mark delivered twice to a stream that keeps recent marks only."""
    out, marks = scratch_path(spark, "recent"), scratch_path(spark, "recent-marks")
    twice = _marks(_event_stream(spark, sf_dir)).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    _finish(a.write_recent_activity(twice, out, marks, available_now=True))
    return _timed(a.merge_recent(spark.read.parquet(out)).select("machine", "n_marks", *_TIMES))


_TIMEOUT = 21600
_MARKED = "SELECT user_id AS machine, ts FROM events WHERE ts IS NOT NULL"
_GAPS_SQL = f"""marked AS ({_MARKED}),
paired AS (SELECT machine, ts AS idle_from, lead(ts) OVER (PARTITION BY machine ORDER BY ts) AS next_mark FROM marked)"""
_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "idle_gaps",
    f"""WITH {_GAPS_SQL}, ended AS (SELECT machine, idle_from, coalesce(next_mark, TIMESTAMP '2024-02-01 00:00:00') AS idle_until FROM paired)
        SELECT machine, strftime(idle_from, {_STAMP}) AS idle_from, strftime(idle_until, {_STAMP}) AS idle_until,
               round((epoch_us(idle_until) - epoch_us(idle_from)) / 1000000.0, 6) AS idle_seconds
        FROM ended WHERE epoch_us(idle_until) - epoch_us(idle_from) > {_TIMEOUT}000000""",
)
def idle_gaps(spark, sf_dir):
    """All idle times of machines in history and up to the end of the month."""
    gaps = a.idle_gaps(_marks(table(spark, sf_dir, "events")), _TIMEOUT, until=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return _stamped(gaps.withColumn("idle_seconds", F.round("idle_seconds", 6)), "idle_from", "idle_until")


_SESSIONS_SQL = f"""marked AS ({_MARKED}),
begun AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_TIMEOUT}000000, true) AS starts FROM marked WINDOW w AS (PARTITION BY machine ORDER BY ts)),
numbered AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY machine ORDER BY ts) AS k FROM begun),
sessions AS (SELECT machine, k, min(ts) AS active_from, max(ts) AS active_until, count(*) AS n_marks FROM numbered GROUP BY machine, k)"""


@query(
    "activity_sessions",
    f"""WITH {_SESSIONS_SQL} SELECT machine, strftime(active_from, {_STAMP}) AS active_from, strftime(active_until, {_STAMP}) AS active_until, n_marks FROM sessions""",
)
def activity_sessions(spark, sf_dir):
    return _stamped(a.activity_sessions(_marks(table(spark, sf_dir, "events")), _TIMEOUT), "active_from", "active_until")


@query(
    "closed_sessions_stream",
    f"""WITH {_SESSIONS_SQL}, mark AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM marked)
        SELECT machine, strftime(active_from, {_STAMP}) AS active_from, strftime(active_until, {_STAMP}) AS active_until, n_marks
        FROM sessions, mark WHERE epoch_us(active_until) + {_TIMEOUT}000000 <= w * 1000""",
)
def closed_sessions_stream(spark, sf_dir):
    """Sessions that the watermark has closed by the end of the stream."""
    out, marks = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-marks")
    _finish(a.write_closed_sessions(_marks(_event_stream(spark, sf_dir)), out, marks, _TIMEOUT, available_now=True))
    schema = "machine BIGINT, active_from TIMESTAMP, active_until TIMESTAMP, n_marks BIGINT"
    return _stamped(spark.read.schema(schema).parquet(out), "active_from", "active_until")


@query(
    "idle_machines_stream",
    f"""WITH marked AS ({_MARKED}), mark AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM marked)
        SELECT machine, epoch_us(max(ts)) + {_TIMEOUT}000000 <= any_value(w) * 1000 AS is_idle FROM marked, mark GROUP BY machine""",
)
def idle_machines_stream(spark, sf_dir):
    """Machines idle when the stream ends, told by their closed sessions alone."""
    out, marks = scratch_path(spark, "idle"), scratch_path(spark, "idle-marks")
    _finish(a.write_closed_sessions(_marks(_event_stream(spark, sf_dir)), out, marks, _TIMEOUT, available_now=True))
    closed = spark.read.schema("machine BIGINT, active_from TIMESTAMP, active_until TIMESTAMP, n_marks BIGINT").parquet(out)
    last = _marks(table(spark, sf_dir, "events")).groupBy("machine").agg(F.max("at").alias("last_active"))
    return a.idle_by_sessions(last, closed).select("machine", "is_idle")
