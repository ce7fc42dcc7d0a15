"""Conversations from messages that quote each other.

A line's quote level is the number of ``>`` before its text. Runs of lines of one level, ended by a blank line or
another level, are passages; they are normalised (lower case, single spaces) and hashed. Quoted passages are joined to
the messages that wrote them: the earliest in the same channel, else the earliest of all, and always an earlier
one than the quoting message. A message answers the author of its outermost quotes; of several, the one with most
quoted characters, then the earliest. The way around the tree of answers (into each message, its answers in order of
id, and out of it) gives root, depth and place: a conversation is in reply order, every message followed by the answers to
it and theirs, when sorted by place, and its texts are those without quoted lines.

Ids are lists of columns in posting order. Defined results: a null text is empty; a message that quotes nothing known
starts a conversation; rows with the same id are one message as far as answers go, each with its own text. Nulls in
ids sort first and compare as equal. A text of any length is taken whole, as one row. An empty table gives an empty
result; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import stored
from .common import SPACE_RUN, SPACES, digest, text_of

_MARKS = r"^([ \t]*>)+"


def _line(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    body = F.btrim(F.substr(line, F.char_length(marks) + 1), F.lit(SPACES))
    level = F.char_length(F.translate(marks, " \t", ""))
    return F.struct(level.alias("level"), F.lower(F.regexp_replace(body, SPACE_RUN, " ")).alias("body"), line.alias("line"))


def passages(messages: DataFrame, id_columns: list[str], channel: list[str], text: str = "text") -> DataFrame:
    """Per message ``id``, ``channel``, ``own`` (text without quoted lines) and ``passages`` (level, hash, n characters)."""
    df = messages.select(
        F.struct(*id_columns).alias("id"), F.struct(*channel).alias("channel"), F.transform(F.split(text_of(text), "\n"), _line).alias("_split")
    )
    df = once(df, _l=F.col("_split")).drop("_split")
    blank = F.lit(SPACES)

    def starts(i: Column) -> Column:
        this, last = F.element_at("_l", i), F.element_at("_l", F.greatest(i - 1, F.lit(1)))
        return (this["body"] != "") & ((i == 1) | (this["level"] != last["level"]) | (last["body"] == ""))

    def ends(i: Column) -> Column:
        this, following = F.element_at("_l", i), F.element_at("_l", F.least(i + 1, F.size("_l")))
        return (this["body"] != "") & ((i == F.size("_l")) | (this["level"] != following["level"]) | (following["body"] == ""))

    places = F.sequence(F.lit(1), F.size("_l"))
    df = once(df, _s=F.filter(places, starts), _e=F.filter(places, ends))

    def passage(s: Column, e: Column) -> Column:
        body = F.array_join(F.transform(F.slice("_l", s, e - s + 1), lambda x: x["body"]), " ")
        return F.struct(F.element_at("_l", s)["level"].alias("level"), digest(body).alias("hash"), F.char_length(body).alias("n"))

    own = F.array_join(F.transform(F.filter("_l", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return df.select("id", "channel", F.btrim(own, blank).alias("own"), F.zip_with("_s", "_e", passage).alias("passages"))


def answers(parsed: DataFrame) -> DataFrame:
    """``id`` and ``parent`` of every message that quotes an earlier one."""
    each = parsed.select("id", "channel", F.explode("passages").alias("p")).select("id", "channel", "p.level", "p.hash", "p.n")
    wrote = each.where("level = 0").groupBy("hash", "channel").agg(F.min("id").alias("near"))
    anyone = wrote.groupBy(F.col("hash").alias("h")).agg(F.min("near").alias("far"))
    quoted = each.where("level > 0").groupBy("id", "channel", "hash").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    met = quoted.join(wrote, ["hash", "channel"], "left")
    met = met.join(anyone, met["hash"] == anyone["h"], "left")
    author = F.when(F.col("near") < F.col("id"), F.col("near")).when(F.col("far") < F.col("id"), F.col("far"))
    told = met.select("id", "level", "n", author.alias("parent")).where("parent IS NOT NULL")
    told = told.groupBy("id", "level", "parent").agg(F.sum("n").alias("n"))
    return told.groupBy("id").agg(F.min(F.struct("level", -F.col("n"), "parent")).alias("best")).select("id", "best.parent")


def _elder(answers: DataFrame) -> DataFrame:
    """``i`` and ``elder``, the answer before it to the same message, of answers (``id``, ``parent``) that have one.

    Ranges of (parent, id) split the answers of a message that has very many; only the last row of each range, a row per
    partition, is looked at by itself.
    """
    ranged = stored(answers.repartitionByRange("parent", "id").select("id", "parent", F.spark_partition_id().alias("at")))
    one = F.struct("parent", "id")
    last = ranged.groupBy("at").agg(F.max(one).alias("last"))
    before = last.select(F.col("at").alias("a"), F.lag("last").over(Window.orderBy("at")).alias("ended"))
    inside = ranged.select("*", F.lag(one).over(Window.partitionBy("at").orderBy("parent", "id")).alias("same_range"))
    met = inside.join(before, F.col("at") == F.col("a")).select("id", "parent", F.coalesce("same_range", "ended").alias("elder"))
    return met.where("elder.parent = parent").select(F.col("id").alias("i"), F.col("elder.id").alias("elder"))


def threads(parents: DataFrame) -> DataFrame:
    """``id``, ``parent``, ``root``, ``depth`` and ``place`` (from 0, in reply order) for every message of ``parents`` (``id``, ``parent``, null for none).

    The way around a tree enters and leaves each message; every step knows the one before it. Each round doubles the steps back that a
    step knows, so rounds grow with the logarithm of the thread's size, whatever its shape; no two steps still on their way
    know the same one, so no key is hot, and steps that know the way's start take no part in later rounds.
    """
    linked = parents.where("parent IS NOT NULL").select("id", "parent")
    youngest = linked.groupBy(F.col("parent").alias("p")).agg(F.max("id").alias("youngest"))
    met = parents.select("id", "parent").join(_elder(linked), F.col("id") == F.col("i"), "left").join(youngest, F.col("id") == F.col("p"), "left")

    def step(message: Column | str, leaves: Column) -> Column:
        return F.struct(F.col(message).alias("id"), leaves.alias("leaves"))

    enters, leaves = F.lit(False), F.lit(True)
    before_in = F.when(F.col("elder").isNotNull(), step("elder", leaves)).when(F.col("parent").isNotNull(), step("parent", enters))
    before_out = F.when(F.col("youngest").isNotNull(), step("youngest", leaves)).otherwise(step("id", enters))
    both = F.array(F.struct(step("id", enters).alias("at"), before_in.alias("up")), F.struct(step("id", leaves).alias("at"), before_out.alias("up")))
    steps = met.select("id", "parent", F.explode(both).alias("s")).select("id", "parent", "s.at", "s.up")
    entered = F.when(F.col("up").isNull(), 0).otherwise(F.when(F.col("up.leaves"), 0).otherwise(1))
    net = F.when(F.col("up").isNull(), 0).otherwise(F.when(F.col("up.leaves"), -1).otherwise(1))
    known = stored(steps.select(
        "id", "parent", "at", F.coalesce("up", "at").alias("up"), net.alias("depth"), entered.cast("long").alias("place"), F.col("up").isNull().alias("done")))
    while True:
        above = known.select(
            F.col("at").alias("a"), F.col("up").alias("next"), F.col("depth").alias("deeper"), F.col("place").alias("more"), F.col("done").alias("at_start"))
        moved = known.where("NOT done").join(above, F.col("up") == F.col("a")).select(
            "id", "parent", "at", F.col("next").alias("up"), (F.col("depth") + F.col("deeper")).alias("depth"),
            (F.col("place") + F.col("more")).alias("place"), F.col("at_start").alias("done"))
        known = stored(known.where("done").union(moved))
        if known.where("NOT done").isEmpty():
            return known.where("NOT at.leaves").select("id", "parent", F.col("up.id").alias("root"), "depth", "place")


def conversations(messages: DataFrame, id_columns: list[str], channel: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per message ``id``, ``parent``, ``root``, ``depth``, ``place`` in reply order, ``n_quotes`` and ``own``, its text without quotes."""
    parsed = stored(passages(messages, id_columns, channel or id_columns[:1], text))
    found = answers(parsed)
    ids = parsed.select("id").distinct().join(found, "id", "left")
    linked = threads(ids)
    quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes")
    return parsed.select("id", "own", quotes).join(linked, "id")
