"""Quantiles by group.

Two ways, chosen by the caller:

``exact``
    Count and store the values of each group, then narrow down: as long as the part of a group that holds
    a wanted rank has more distinct values than one task should sort, cut that part into buckets at the
    bounds of a sketch and keep the buckets that hold a wanted rank. What is left is ranked. Every
    group, small or large, goes through the same steps and the same interpolation.
``approx``
    ``percentile_approx``: one pass, mergeable sketches, a set relative rank error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

_COARSE = 16
_FINE = 16
_SKETCH_SIZE = 1000
#: Distinct values of one part of a group that one task sorts.
SORTED_VALUES = 100_000


def count_values(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """Rows per group and value, missing values left out, as ``g`` (the keys), ``value`` and ``count``.

    Rows are combined before the shuffle, and a hot group spreads by value. The keys travel as one
    struct: structs with missing fields equal each other, so later joins on ``g`` are plain equi-joins.
    """
    column = F.col(value) if isinstance(value, str) else value
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    valued = df.select(group.alias("g"), column.cast("double").alias("value")).where(F.col("value").isNotNull())
    return valued.groupBy("g", "value").agg(F.count(F.lit(1)).alias("count"))


def _terms(parts: list[str]) -> str:
    return " + ".join(f"cast(value > {p} AS INT)" for p in parts)


def _positions(p: float, interpolation: str) -> tuple[str, str, str]:
    """Ranks from 0 of the two values around a quantile and the share of the upper one."""
    if interpolation == "linear":
        at = f"({float(p)}D * (n - 1))"
        return f"floor({at})", f"ceil({at})", f"({at} - floor({at}))"
    rank = f"(greatest(ceil({float(p)}D * n), 1) - 1)"
    return rank, rank, "0D"


def _picked(running: DataFrame, ranks: list[tuple[str, str, str]]) -> DataFrame:
    """Quantiles from rows of (g, value, count, n, upto), where upto counts the group's rows up to the value."""

    def at(rank: str, name: str) -> Column:
        return F.expr(f"max(value) FILTER (WHERE {rank} < upto AND {rank} >= upto - count)").alias(name)

    picked = running.groupBy("g").agg(
        F.max("n").alias("n"),
        *[at(low, f"low{i}") for i, (low, _, _) in enumerate(ranks)],
        *[at(high, f"high{i}") for i, (_, high, _) in enumerate(ranks)],
    )
    values = ", ".join(f"low{i} + (high{i} - low{i}) * {share}" for i, (_, _, share) in enumerate(ranks))
    return picked.select("g", "n", F.expr(f"array({values})").alias("quantiles"))


def _narrowed(parts: DataFrame, ranks: list[tuple[str, str, str]], limit: int) -> DataFrame | None:
    """Parts of more than ``limit`` values cut into buckets, without the buckets that hold no wanted rank; None if no part is that large.

    The bounds come from a sketch whose figures depend on merge order. They are stored, so every later
    step and every repeated task reads the same ones; the result is exact with any bounds.
    """
    values = F.count(F.lit(1)).alias("values")
    large = stored(parts.groupBy("g", "part").agg(values).where(F.col("values") > limit).select("g", "part"))
    if large.isEmpty():
        return None
    steps = _COARSE * _FINE
    shares = ", ".join(f"{i / steps}D" for i in range(steps))
    bounds = stored(
        parts.join(large, ["g", "part"])
        .groupBy("g", "part")
        .agg(F.expr(f"kll_sketch_agg_double(value, {_SKETCH_SIZE})").alias("sketch"))
        .select("g", "part", F.expr(f"kll_sketch_get_quantile_double(sketch, array({shares}))").alias("bounds"))
    )
    # A coarse and a fine step of plain comparisons keep the search inside generated code.
    # Buckets are never missing; saying so spares a null filter that would copy the whole search.
    coarse = f"coalesce({_terms([f'bounds[{_FINE * i}]' for i in range(1, _COARSE)])}, 0)"
    fine = _terms([f"bounds[coarse * {_FINE} + {j}]" for j in range(_FINE)])
    cut = parts.join(bounds, ["g", "part"], "left").select(
        "g", "part", "value", "count", "n", "before", "bounds", F.expr(coarse).alias("coarse")
    )
    cut = cut.select(
        "g", "part", "value", "count", "n", "before", F.expr(f"coalesce(coarse * {_FINE + 1} + {fine}, 0)").alias("bucket")
    )
    wanted = dict.fromkeys(r for low, high, _ in ranks for r in (low, high))
    # A part has at most a few hundred bucket rows, whatever its size.
    needed = (
        cut.groupBy("g", "part", "bucket")
        .agg(F.sum("count").alias("held"), F.max("n").alias("n"), F.max("before").alias("ahead"))
        .withColumn("start", F.expr("ahead + sum(held) OVER (PARTITION BY g, part ORDER BY bucket) - held"))
        .where(" OR ".join(f"({r} >= start AND {r} < start + held)" for r in wanted))
        .select("g", "part", "bucket", "start")
    )
    inside = cut.drop("before").join(needed, ["g", "part", "bucket"])
    width = (_COARSE + 1) * (_FINE + 1)
    return stored(
        inside.select("g", (F.col("part") * width + F.col("bucket")).alias("part"), "value", "count", "n", F.col("start").alias("before"))
    )


def _exact(counted: DataFrame, probs: list[float], interpolation: str, limit: int) -> DataFrame:
    ranks = [_positions(p, interpolation) for p in probs]
    totals = counted.groupBy("g").agg(F.sum("count").alias("n"))
    parts = counted.join(totals, "g").select("g", F.lit(0).cast("long").alias("part"), "value", "count", "n", F.lit(0).cast("long").alias("before"))
    while (finer := _narrowed(parts, ranks, limit)) is not None:
        parts = finer
    running = "before + sum(count) OVER (PARTITION BY g, part ORDER BY value ROWS UNBOUNDED PRECEDING)"
    return _picked(parts.select("g", "value", "count", "n", F.expr(running).alias("upto")), ranks)


def quantiles_of_counts(
    counted: DataFrame, probs: list[float], interpolation: str = "linear", limit: int = SORTED_VALUES
) -> DataFrame:
    """Quantiles of ``count_values`` output: ``g``, ``n`` and an array in the order of ``probs``.

    It reads its input several times: give it a stored frame. ``limit`` is the number of values one task sorts.
    """
    if interpolation not in ("linear", "discrete"):
        raise ValueError("interpolation is 'linear' or 'discrete'")
    return _exact(counted, list(probs), interpolation, limit)


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    interpolation: str = "linear",
    method: str = "exact",
    accuracy: int = 10000,
) -> DataFrame:
    """Quantiles of a column by group; groups without any value do not appear.

    The exact way counts values and stores the counts when called; the rest stays lazy.
    """
    if method == "approx":
        valued = df.where(F.col(value).isNotNull())
        return valued.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy).alias("quantiles"),
        )
    if method != "exact":
        raise ValueError("method is 'exact' or 'approx'")
    found = quantiles_of_counts(stored(count_values(df, keys, value)), probs, interpolation)
    return found.select(*[F.col(f"g.{k}").alias(k) for k in keys], "n", "quantiles")
