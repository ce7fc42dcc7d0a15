"""License detections by ordered signature rules: hundreds of patterns behind keyword gates, overlaps settled by priority.

A text is looked at by rules only if it has one of the rules' stems, one search for all of them. Of such texts the words are
written one after another, and a rule's pattern runs only where its keyword is among them. Every match is a detection: label,
priority, first word and the word behind the last. A detection inside another is dropped if the other has a higher priority, or
an equal one and is longer or stands first in the order of rules. Everything stays in the document's row: no shuffle.

Defined results: a null text is empty and has no words, labels or detections, and score 0. Texts are searched whole, whatever
their length; work on a long text with many detections grows a little faster than their number. Repeated rows are judged each
and alike. An empty table gives no rows; columns of other names stay in ``row``, so that none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from .common import text_of
from .signatures import BASE, CONFIDENCE, RULES, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, and words (fixed values). Texts are lowered before the first is used, not before the second.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CHUNK = 64


def spaced(pattern: str) -> str:
    """The pattern over words that each have a space of their own at either end, so that matches lie between words."""
    return " (?:" + pattern.replace(" ", "  ") + ") "


def stems(rules: tuple[Rule, ...]) -> str:
    """One pattern for raw text that finds any rule's stem where a word begins."""
    kinds = sorted({r.stem for r in rules} | {"license"})
    short = [k for k in kinds if not any(o != k and k.startswith(o) for o in kinds)]
    return "(?i)(?<![0-9A-Za-z])(?:" + "|".join(k.replace(" ", "[^0-9A-Za-z]+") for k in short) + ")"


def _array(rules: tuple[Rule, ...]) -> Column:
    """The rules as one constant column; their number is that of the table above."""
    return F.array(*(F.struct(
        F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
        F.lit(f" {r.keyword} " if r.keyword else "").alias("keyword"), F.lit(spaced(r.pattern)).alias("pattern")) for i, r in enumerate(rules)))


def _intervals(text: Column, pattern: Column) -> Column:
    """First word and the word behind the last of every match: matches are marked by words of their own, whose places tell."""
    marked = F.split(F.btrim(F.regexp_replace(text, pattern, F.lit(" \x01 $0 \x02 ")), F.lit(" ")), "  ")

    def found(mark: str) -> Column:
        return F.filter(F.transform(marked, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())

    starts = F.transform(found("\x01"), lambda i, k: i - 2 * k)
    ends = F.transform(found("\x02"), lambda i, k: i - 2 * k - 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")))


def _detections(rules: Column) -> Column:
    ready = F.filter(rules, lambda r: F.contains("_plain", r["keyword"]))
    return F.flatten(F.transform(ready, lambda r: F.transform(_intervals(F.col("_plain"), r["pattern"]), lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["rule"].alias("rule"), r["label"].alias("label")))))


def _base_places(label: str, phrase: str) -> Column:
    met = F.when(F.contains("_plain", F.lit(" " + phrase.replace(" ", "  ") + " ")), _intervals(F.col("_plain"), F.lit(spaced(phrase))))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.transform(F.coalesce(met, none), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))


def _farthest(some: Column, priority: Column) -> Column:
    """Greatest end among detections of at least the priority; 0 for none."""
    return F.aggregate(some, F.lit(0).cast("long"), lambda top, d: F.when(-d["minus_priority"] >= priority, F.greatest(top, -d["minus_end"])).otherwise(top))


def _outermost(df: DataFrame, priorities: list[int]) -> DataFrame:
    """``_kept``: detections of ``_found`` that none suppresses.

    In the order of start, longer, higher, earlier rule, all that may suppress a detection stand before it, and one of them does
    if it reaches as far. How far is known per block of detections, so that no detection is held against all others.
    """
    blocks = F.when(F.size("_found") > 0, F.sequence(F.lit(0), F.floor((F.size("_found") - 1) / _CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    block = F.transform(blocks, lambda c: F.slice("_found", c * _CHUNK + 1, _CHUNK))
    df = once(df, _reach=F.transform(block, lambda b: F.array(*(_farthest(b, F.lit(p)) for p in priorities))))

    def before(c: Column, k: int) -> Column:
        return F.aggregate(F.slice("_reach", 1, c), F.lit(0).cast("long"), lambda top, r: F.greatest(top, r[k]))

    df = once(df, _ahead=F.transform("_reach", lambda _, c: F.array(*(before(c, k) for k in range(len(priorities))))))
    place = {p: k for k, p in enumerate(priorities)}

    def alone(d: Column, i: Column) -> Column:
        c = F.floor(i / _CHUNK).cast("int")
        k = F.coalesce(*(F.when(-d["minus_priority"] == p, k) for p, k in place.items()))
        near = _farthest(F.slice("_found", c * _CHUNK + 1, i - c * _CHUNK), -d["minus_priority"])
        return F.greatest(F.get(F.get("_ahead", c), k), near) < -d["minus_end"]

    return df.withColumn("_kept", F.filter("_found", alone))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (the document), ``n_words``, base places, ``spans`` of surviving detections, labels and ``score``."""
    t = text_of(text)
    words = F.regexp_replace(F.translate(t, _UPPER, _LOWER), _BETWEEN, "  ")
    df = docs.select(F.struct("*").alias("row"), F.regexp_count(t, F.lit(_WORD)).cast("long").alias("n_words"), F.when(
        F.regexp_like(t, F.lit(stems(rules))), F.concat(F.lit(" "), F.btrim(words, F.lit(" ")), F.lit(" "))).otherwise("").alias("_text"))
    df = once(df, _plain=F.col("_text")).drop("_text")
    places = F.concat(*(_base_places(label, phrase) for label, phrase in BASE))
    df = once(df, _base=places, _found=F.when(F.col("_plain") != "", F.array_sort(_detections(_array(rules)))).otherwise(
        F.array().cast("array<struct<start:bigint,minus_end:bigint,minus_priority:int,rule:int,label:string>>")))
    df = _outermost(df, sorted({r.priority for r in rules}))
    sure = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    starts, base = F.transform("_base", lambda b: b["start"]), F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"])))
    own = F.transform("_kept", lambda d: d["label"])
    best = F.array_max(F.transform("_kept", lambda d: sure[-d["minus_priority"]]))
    return df.select(
        "row", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("_base") > 0, CONFIDENCE[1]).otherwise(0.0)).alias("score"),
        F.transform("_kept", lambda d: F.struct(d["label"].alias("label"), (-d["minus_priority"]).alias("priority"), d["start"].alias("start"), (-d["minus_end"]).alias("end"))).alias("spans"),
    )
