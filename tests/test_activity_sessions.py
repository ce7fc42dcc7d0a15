"""Streams with bounded state and sessions, against batch and plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.operators.quantiles import group_quantiles
from tallygrove.streaming import activity as a

SCHEMA = "machine STRING, kind STRING, at TIMESTAMP"
START = dt.datetime(2024, 1, 1)


def _stream(spark, folder, batches):
    """A file per batch, in order."""
    folder.mkdir()
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _hours(hours):
    return [(f"m{h}-{i}", "cpu", START + dt.timedelta(hours=h, minutes=i)) for h in hours for i in range(20)]


def test_state_falls_and_late_repeats_go(spark, tmp_path, rows):
    """Every hour has machines of its own: state holds the last hours only, and repeats are counted once."""
    batches = [_hours([h]) + (_hours([h - 1])[-3:] if h else []) for h in range(8)]
    very_late = _hours([1])[:5]
    batches.append(_hours([8]) + very_late)
    stream, out = _stream(spark, tmp_path / "in", batches), str(tmp_path / "out")
    job = a.write_recent_activity(stream, out, str(tmp_path / "place"), late="1 hour", available_now=True)
    job.awaitTermination()
    assert job.exception() is None
    held = [p.stateOperators[0].numRowsTotal for p in job.recentProgress if p.stateOperators]
    once = spark.createDataFrame(_hours(range(9)), SCHEMA)
    assert max(held) < 90 and held[-1] < once.count() / 2  # 180 marks in all
    saved = a.merge_recent(spark.read.parquet(out).drop("batch"))
    assert rows(saved.select("machine", "n_marks", "last_active")) == rows(a.recent_activity(once).select("machine", "n_marks", "last_active"))


def _marks():
    rng = random.Random(2)
    marks = [("hot" if rng.random() < 0.4 else f"m{rng.randrange(9)}", "ssh", START + dt.timedelta(seconds=rng.randrange(0, 200_000))) for _ in range(400)]
    exact = [("edge", "cpu", START + dt.timedelta(seconds=s)) for s in (0, 600, 1200, 1801)]
    return marks + exact + [("lone", "boot", START)]


def _sessions(marks, timeout):
    out, by = [], {}
    for machine, _, at in marks:
        by.setdefault(machine, []).append(at)
    for machine, times in by.items():
        times.sort()
        first = last = times[0]
        n = 0
        for at in times:
            if (at - last).total_seconds() > timeout:
                out.append((machine, first, last, n))
                first, n = at, 0
            last, n = at, n + 1
        out.append((machine, first, last, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("timeout", [600, 3600])
def test_sessions_and_gaps(spark, rows, timeout):
    marks = _marks()
    df = spark.createDataFrame([*marks, ("lone", "cpu", None)], SCHEMA).repartition(4)
    want = _sessions(marks, timeout)
    assert rows(a.activity_sessions(df, timeout), "machine", "active_from", "active_until", "n_marks") == want
    gaps = [(m, x[2], y[1]) for m in {w[0] for w in want} for s in [sorted(w for w in want if w[0] == m)] for x, y in zip(s, s[1:])]
    assert rows(a.idle_gaps(df, timeout), "machine", "idle_from", "idle_until") == sorted(gaps, key=repr)
    until = START + dt.timedelta(days=9)
    ended = a.idle_gaps(df, timeout, until=F.lit(until)).where(F.col("idle_until") == until)
    assert rows(ended, "machine") == sorted((m,) for m in {w[0] for w in want})
    assert a.idle_gaps(df.where("false"), timeout).count() == 0


def test_busy_machine_is_condensed_before_sessions_form(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("machine"), F.lit("cpu").alias("kind"), F.timestamp_seconds(F.col("id") % 7200).alias("at"))
    found = a.activity_sessions(df, 600)
    assert [r.n_marks for r in found.collect()] == [200_000]
    plan = found._jdf.queryExecution().toString()
    assert plan.index("MergingSessions") < plan.rindex("partial_min")


def test_closed_sessions_tell_idle_machines(spark, tmp_path, rows):
    marks = sorted(_marks(), key=lambda m: m[2])
    size = len(marks) // 6 + 1
    stream = _stream(spark, tmp_path / "in", [marks[i : i + size] for i in range(0, len(marks), size)])
    out, timeout = str(tmp_path / "out"), 3600
    job = a.write_closed_sessions(stream, out, str(tmp_path / "place"), timeout, late="10 minutes", available_now=True)
    job.awaitTermination()
    assert job.exception() is None
    closed = spark.read.parquet(out)
    now = marks[-1][2] - dt.timedelta(minutes=10)
    want = [s for s in _sessions(marks, timeout) if s[2] + dt.timedelta(seconds=timeout) <= now]
    assert rows(closed, "machine", "active_from", "active_until", "n_marks") == want
    last = a.last_activity(spark.createDataFrame(marks, SCHEMA))
    batch = a.idle_machines(last, F.lit(now), timeout)
    assert rows(a.idle_by_sessions(last, closed), "machine", "is_idle") == rows(batch, "machine", "is_idle")
    assert batch.where("is_idle").count() > 1 and ("lone", True) in rows(batch, "machine", "is_idle")


@pytest.mark.parametrize("accuracy", [100, 1000, 10000])
def test_sketched_quantiles_are_off_by_whole_ranks_of_the_stated_share(spark, accuracy):
    """The stated share of a group's rows, rounded up to a whole row, for groups of 10 to 20,000 rows."""
    for n in (10, 1962, 20_000):
        values = random.Random(n).choices(range(n * 3), k=n)
        df = spark.createDataFrame([(v,) for v in values], "v LONG").repartition(3)
        found = group_quantiles(df, [], "v", [0.1, 0.25, 0.5, 0.9], method="approx", accuracy=accuracy).first().quantiles
        for p, q in zip((0.1, 0.25, 0.5, 0.9), found, strict=True):
            off = -(-n // accuracy)
            assert sum(v < q for v in values) <= p * n + off and sum(v <= q for v in values) >= p * n - off
