"""Ranks and places without sorting rows: compressed bitmaps of integer keys with popcount directories.

Every group has one bitmap over its keys. Tasks set bits in 64-bit words, words of all tasks are merged by OR, and only words
with a bit are kept, 64 of them to a container. A container's directory counts the rows before each of its words; directories of
fan-out 1024 count the rows before each container. The rank of a key is then the counts before it and a popcount in its own word.

Defined results: a null key comes before all others; rows of a null group are a group. A key that several rows hold adds its
number to the counts. Nothing here sorts or collects a group: a container holds 4096 keys, a directory 1024 entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Bits of a key within a word, and within a container.
WORD, CONTAINER = 6, 12
#: Bits by which each directory is coarser than the one below it.
FAN = 10


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def _bit(key: str) -> Column:
    return F.expr(f"cast(`{key}` & {(1 << WORD) - 1} as int)")


def bitmap(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """One row per group and container: its ``_rows`` and ``_words`` of (word, bits, repeats, rows before it)."""
    ids = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_n"))
    more = F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct(_bit(key).alias("bit"), (F.col("_n") - 1).alias("more")))))
    words = ids.groupBy(*group, F.shiftright(key, WORD).alias("_word")).agg(
        F.coalesce(F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & {(1 << WORD) - 1} as int))")), F.lit(0)).alias("bits"),
        more.alias("repeats"), F.sum("_n").alias("rows"),
    )
    held = F.array_sort(F.collect_list(F.struct(F.col("_word").alias("word"), "bits", "repeats", "rows")))
    containers = words.groupBy(*group, F.shiftright("_word", CONTAINER - WORD).alias("_container")).agg(
        F.sum("rows").alias("_rows"), held.alias("_held"))
    before = F.transform("_held", lambda w, i: F.struct(
        w["word"].alias("word"), w["bits"].alias("bits"), w["repeats"].alias("repeats"), w["rows"].alias("rows"),
        F.aggregate(F.slice("_held", 1, i), F.lit(0).cast("long"), lambda n, x: n + x["rows"]).alias("before")))
    return containers.select(*group, "_container", "_rows", before.alias("_words"))


def directory(containers: DataFrame, group: list[str], lowest: int | None, highest: int | None) -> DataFrame:
    """The containers with ``_base``, the rows of the group in containers before them, and ``_total``, all rows of the group.

    ``lowest`` and ``highest`` are the least and greatest key, from which the number of levels follows.
    """
    shift, levels = CONTAINER, []
    here = containers.select(*group, F.col("_container").alias("_node"), F.col("_rows").alias("_n"))
    while True:
        narrow = lowest is None or (highest >> shift) - (lowest >> shift) < 1 << FAN
        parent = [] if narrow else [F.shiftright("_node", FAN)]
        ahead = Window.partitionBy(*group, *parent).orderBy(F.asc_nulls_first("_node")).rowsBetween(Window.unboundedPreceding, -1)
        counted = here.select(*group, "_node", "_n", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
                              *([F.sum("_n").over(Window.partitionBy(*group)).alias("_all")] if narrow else []))
        levels.append(counted)
        if narrow:
            break
        here = here.groupBy(*group, F.shiftright("_node", FAN).alias("_node")).agg(F.sum("_n").alias("_n"))
        shift += FAN
    names = [f"_g{i}" for i in range(len(group))]
    known = levels[-1]
    for below in reversed(levels[:-1]):
        above = known.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_node").alias("_up"),
                             F.col("_before").alias("_ahead"), "_all")
        on = _same([*((F.col(g), F.col(n)) for g, n in zip(group, names, strict=True)), (F.shiftright("_node", FAN), F.col("_up"))])
        known = below.join(above, on).select(*group, "_node", "_n", (F.col("_before") + F.col("_ahead")).alias("_before"), "_all")
    places = known.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_node").alias("_c"),
                          F.col("_before").alias("_base"), F.col("_all").alias("_total"))
    on = _same([*((F.col(g), F.col(n)) for g, n in zip(group, names, strict=True)), (F.col("_container"), F.col("_c"))])
    return containers.join(places, on).select(*group, "_container", "_words", "_base", "_total")


def ranks(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """The rows with ``_before`` (rows of their group with a smaller key), ``_same`` (with the same key) and ``_total`` (all).

    ``df`` is read several times: hand in a stored frame. ``key`` is a long.
    """
    lowest, highest = df.agg(F.min(key), F.max(key)).first()
    found = stored(directory(stored(bitmap(df, group, key)), group, lowest, highest))
    names = [f"_g{i}" for i in range(len(group))]
    held = found.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_container").alias("_c"), "_words", "_base", "_total")
    on = _same([*((F.col(g), F.col(n)) for g, n in zip(group, names, strict=True)), (F.shiftright(key, CONTAINER), F.col("_c"))])
    word = F.filter("_words", lambda w: w["word"].eqNullSafe(F.shiftright(key, WORD)))[0]
    met = df.join(held, on).select(*df.columns, "_base", "_total", word.alias("_w"), _bit(key).alias("_bit"))
    below = F.bit_count(F.col("_w.bits").bitwiseAND(F.expr("~shiftleft(-1L, _bit)")))
    repeats = F.aggregate(F.filter("_w.repeats", lambda r: r["bit"] < F.col("_bit")), F.lit(0).cast("long"), lambda n, r: n + r["more"])
    own = F.filter("_w.repeats", lambda r: r["bit"] == F.col("_bit"))
    same = F.when(F.col("_bit").isNull(), F.col("_w.rows")).otherwise(1 + F.coalesce(F.get(own, F.lit(0))["more"], F.lit(0)))
    return met.select(
        *df.columns, (F.col("_base") + F.col("_w.before") + F.coalesce(below + repeats, F.lit(0))).alias("_before"),
        same.alias("_same"), "_total",
    )


def places(df: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """The rows with ``_place``, from 0 without gaps by ``keys`` in turn, and ``_total``, the rows of their group.

    Rows alike in all keys stand next to each other in a fixed but unnamed order. Names that begin with ``_`` are taken here.
    """
    numbered = df.select("*", F.monotonically_increasing_id().alias("_any"), F.lit(0).cast("long").alias("_ahead"), F.lit(None).cast("long").alias("_all"))
    return _places(stored(numbered), group, [*keys, "_any"]).select(*df.columns, "_place", "_total")


def _places(df: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """``_ahead`` are the rows before the group, ``_all`` the rows of the first group, where this one is part of another."""
    ranked = stored(ranks(df, group, keys[0])).withColumn("_ahead", F.col("_ahead") + F.col("_before")).withColumn(
        "_all", F.coalesce("_all", "_total")).drop("_before", "_total")
    tied = ranked.where("_same > 1").drop("_same")
    last = len(keys) == 1 or tied.isEmpty()
    alone = (ranked if last else ranked.where("_same = 1")).drop("_same").withColumnsRenamed({"_ahead": "_place", "_all": "_total"})
    return alone if last else alone.unionByName(_places(tied, [*group, keys[0]], keys[1:]))
