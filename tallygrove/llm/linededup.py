"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are a window. A window that is there more than once, in one document
or in several, stays where it is first (smallest id, then text, then place); all lines covered by a later occurrence
go. Windows of blank lines alone do not count. Lines are compared as they are, by 128 bits.

Defined results: a null text has no lines and stays null; a text without lines to remove stays as it is; a text whose
lines all go becomes empty. Texts of fewer than three lines have no window. Every row is a document of its own: a null
id comes after all others, rows that share an id, null or not, follow each other by a hash of their text, and of rows with
the same id and text one is first and the others lose every window. An empty table gives an empty result. A text of any
length is taken whole, as one row. The document comes back as ``row``, so its columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import stored, written
from .common import SPACES, digest

WIDTH = 3


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document ``id``, ``mark`` (stands for its text), ``first``: each distinct window's first place, ``later``: other places."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            F.xxhash64(line).alias("a"), F.xxhash64(F.lit("b"), line).alias("b"), (F.btrim(line, F.lit(SPACES)) == "").alias("blank")
        ),
    )
    df = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), lines.alias("_lines"))
    df = once(df.where(F.size("_lines") >= width), _l=F.col("_lines")).drop("_lines")

    def window(i):
        at = [F.element_at("_l", i + k) for k in range(width)]
        blank = at[0]["blank"]
        for line in at[1:]:
            blank = blank & line["blank"]
        return F.when(~blank, F.struct(F.xxhash64(*(x["a"] for x in at)).alias("a"), F.xxhash64(*(x["b"] for x in at)).alias("b"), i.alias("place")))

    found = F.transform(F.sequence(F.lit(1), F.size("_l") - (width - 1)), window)
    df = once(df, _w=F.sort_array(F.filter(found, lambda w: w.isNotNull()))).drop("_l")
    before = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint,place:int>")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))))
    told = F.zip_with(
        "_w", F.slice(before, 1, F.size("_w")),
        lambda w, p: F.struct(w.alias("w"), F.coalesce((w["a"] == p["a"]) & (w["b"] == p["b"]), F.lit(False)).alias("again")),
    )
    df = once(df.where(F.size("_w") > 0), _told=told).drop("_w")
    return df.select(
        "id", "mark", F.transform(F.filter("_told", lambda x: ~x["again"]), lambda x: x["w"]).alias("first"),
        F.transform(F.filter("_told", lambda x: x["again"]), lambda x: x["w"]["place"]).alias("later"),
    )


def later_windows(seen: DataFrame) -> DataFrame:
    """``id``, ``mark`` and ``places`` (from 1) of the ``windows`` that are there earlier, for documents that have such."""
    each = seen.select("id", "mark", F.explode("first").alias("w")).select("id", "mark", "w.a", "w.b", "w.place")
    # Counts and first documents need no place, so they are summed by every task before the shuffle.
    document = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    many = each.groupBy("a", "b").agg(F.min(document).alias("lead"), F.count("*").alias("n")).where("n > 1")
    is_lead = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("mark") == F.col("lead.mark"))
    elsewhere = each.join(many, ["a", "b"]).where(~is_lead).select("id", "mark", "place")
    here = seen.where(F.size("later") > 0).select("id", "mark", F.explode("later").alias("place"))
    return elsewhere.union(here).groupBy("id", "mark").agg(F.collect_set("place").alias("places"))


def _same(a: str, b: str) -> Column:
    """Rows keyed ``a`` and ``b`` have the same id and text."""
    return F.col(f"{a}_key").eqNullSafe(F.col(f"{b}_key")) & (F.col(f"{a}_text") == F.col(f"{b}_text"))


def _with_places(rows: DataFrame, seen: DataFrame, later: DataFrame) -> DataFrame:
    """``row`` and ``places`` of rows (``row``, ``r_key``, ``r_text``): those of ``later``, or all, where a row of this id and text comes before.

    Only ids and texts that are there more than once are looked at; their equal rows are counted by every task
    before the shuffle, so a row may be repeated any number of times.
    """
    keys = seen.groupBy(F.col("id").alias("s_key"), F.col("mark").alias("s_text"))
    every = F.concat(F.transform("first", lambda w: w["place"]), "later")
    # A table, so that the planner knows its size: mostly none or few.
    several = written(keys.agg(F.count("*").alias("n"), F.first(every).alias("every")).where("n > 1").drop("n"), "repeated-texts")
    alone = rows.join(several.select("s_key", "s_text"), _same("r", "s"), "left_anti").join(later, _same("r", "w"), "left").select("row", "places")
    again = rows.join(several, _same("r", "s")).groupBy("r_key", "r_text", digest("row").alias("kind"))
    again = stored(again.agg(F.first("row").alias("row"), F.first("every").alias("every"), F.count("*").alias("n")))
    lead = again.groupBy(F.col("r_key").alias("l_key"), F.col("r_text").alias("l_text")).agg(F.min("kind").alias("lead"))
    copies = again.join(lead, _same("r", "l")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    first = (F.col("kind") == F.col("lead")) & (F.col("copy") == 1)
    met = copies.select("row", "r_key", "r_text", "every", first.alias("first")).join(later, _same("r", "w"), "left")
    return alone.union(met.select("row", F.when(F.col("first"), F.col("places")).otherwise(F.col("every")).alias("places")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``row``, ``n_lines``, ``removed`` (places of removed lines, from 1) and ``kept_text``."""
    seen = stored(windows(docs, key, text, width))
    later = stored(later_windows(seen)).select(F.col("id").alias("w_key"), F.col("mark").alias("w_text"), "places")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("r_key"), F.xxhash64(text).alias("r_text"))
    met = _with_places(rows, seen, later)
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(*(p + k for k in range(width))))))
    met = once(met, removed=F.when(F.col("places").isNotNull(), F.sort_array(covered)), _l=F.split(f"row.{text}", "\n"))
    left = F.array_except(F.sequence(F.lit(1), F.size("_l")), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at("_l", i)), "\n")
    return met.select(
        "row", F.coalesce(F.size("_l"), F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.when(F.col("removed").isNull(), F.col(f"row.{text}")).otherwise(kept).alias("kept_text"),
    )
