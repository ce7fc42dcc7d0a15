"""Mixing sources to target weights, in blocks of tokens (here: words).

Each source is one stream of its documents' words, cut into blocks of fixed length; its last block may be shorter.
Targets share a budget by weight and stop at ``most`` times the source's size. First counts per output shard and source
are drawn: a source's draws, as many as its target needs, are dealt to shards at random, so its counts are
multinomial. Their running sums number the slots, a shard's slots of a source in a row. A slot takes the block that a
pseudorandom permutation of the source's whole blocks gives for it, one permutation for each pass over the source; a
shorter last block closes each pass. The last slot takes as many words of its block as the target has left. A join on
(source, block number) brings blocks and slots together.

Defined results: a null text has no words, and a document without words is not taken. Sources without words have
target 0; a null source is a source of its own, last in order. Repeated rows are separate documents. A text of any length is taken whole, as one row. An empty table
gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import stored
from .common import SPACES, running_before, text_of, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
BLOCK = 128
#: Output shards; 64 at most, as documents carry theirs as bits.
SHARDS = 64
SEED = 20_240
#: Documents of a source that are summed in one task.
BUCKET_ROWS = 4096
#: Draws of a source that are made from one row.
_CHUNK = 4096
_ROUNDS = 24


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Per source ``sid`` (from 0), ``source_size``, ``n_docs`` and ``target``.

    Windows without a key run over sources, not documents. Sources ordered by size over weight are full in that
    order; the first that its share of what is left does not fill gives the level for it and all after it.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights)) + 1)
    sizes = sizes.select("*", place.alias("sid")).withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = (budget * total - full) / rest
    sizes = sizes.select("*", level.alias("level")).withColumn("open", F.col("weight") * F.col("level") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level")))).over(Window.partitionBy())
    share = F.col("weight") * F.coalesce(final["level"], F.lit(float("inf")))
    return sizes.select("source", "sid", "source_size", "n_docs", F.least("cap", share).alias("target"))


def _permuted(index: Column, n: Column, *seed: Column) -> Column:
    """Where a pseudorandom permutation of 0 to n - 1 sends ``index``.

    Each round mirrors at a random point and keeps or swaps the two mirror places by one random bit of the larger.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("mirror"), r, *seed), n) - x + n, n)
        swap = F.xxhash64(F.greatest(x, other), r, *seed).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index, step)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) as rows of at most ``_CHUNK`` numbers, over all tasks."""
    chunks = rows.select("*", F.explode(F.sequence("start", F.col("end") - 1, F.lit(_CHUNK).cast("long"))).alias("from"))
    # A number given is kept: chunk rows look small, but each makes thousands of draws.
    chunks = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "from")
    return chunks.withColumn("slot", F.explode(F.sequence("from", F.least(F.col("from") + _CHUNK, F.col("end")) - 1))).drop("start", "end", "from")


def shard_counts(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Multinomial draws per ``sid`` and output ``shard``: ``n``, and ``first``, the slot its own begin with."""
    passes, left = F.floor(F.col("words") / F.col("source_size")), F.pmod("words", "source_size")
    n = passes * F.ceil(F.col("source_size") / block) + F.ceil(left / block)
    some = sources.where("source_size > 0").select("sid", "source_size", F.round("target").cast("long").alias("words"))
    some = some.select("sid", F.lit(0).cast("long").alias("start"), n.cast("long").alias("end")).where("`end` > 0")
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "sid", "slot"), F.lit(shards)).cast("int")
    counts = _dealt(some, "sid").groupBy("sid", shard.alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))


def draws(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per draw: ``sid``, ``shard``, ``slot`` (from 0 in a source), ``block``, the number of the block taken, ``words`` of it, and ``whole``."""
    counts = shard_counts(sources, block, shards, seed)
    counts = counts.select("sid", "shard", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end"))
    sized = sources.select(F.col("sid").alias("s"), "source_size", F.round("target").cast("long").alias("goal"))
    slots = _dealt(counts.join(sized, F.col("sid") == F.col("s")).drop("s"), "sid", "shard")
    full, n_blocks = F.floor(F.col("source_size") / block), F.ceil(F.col("source_size") / block)
    slots = slots.select("*", F.floor(F.col("slot") / n_blocks).alias("turn"), F.pmod("slot", n_blocks).alias("place"))
    moved = _permuted(F.col("place"), F.greatest(full, F.lit(1)), F.lit(seed), F.col("sid"), F.col("turn"))
    slots = slots.select("*", F.when(F.col("place") < full, moved).otherwise(F.col("place")).alias("block"))
    size = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    left = F.col("goal") - F.col("turn") * F.col("source_size") - F.col("place") * block
    return slots.select("sid", "shard", "slot", "block", F.least(size, left).alias("words"), (left >= size).alias("whole"))


def streams(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents (``doc_id``, ``source``, ``size``, ``mark``, ``blank``) with their source's columns and ``start``, their first word's place in its stream."""
    same = docs["source"].eqNullSafe(sources["source"])
    joined = docs.join(sources, same).select(docs["doc_id"], "size", "mark", "blank", "sid", "source_size", "n_docs", "target")
    bucket = F.pmod(F.xxhash64("doc_id", "mark", "blank"), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    order = [F.col("doc_id"), F.col("mark"), F.col("size")]
    return running_before(joined.withColumn("bucket", bucket), ["sid"], "bucket", order, start="size")


def _touching(placed: DataFrame, block: int) -> DataFrame:
    """Documents once for each block they touch (``block``, null for none): ``at``, their first word's place in it, ``first`` word in the document, ``n`` words."""
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = placed.select("*", F.explode_outer(F.when(F.col("size") > 0, touched)).alias("block"))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return pieces.select("*", (low - F.col("block") * block).alias("at"), (low - F.col("start")).alias("first"), (high - low).alias("n"))


def taken_pieces(placed: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents' pieces, one per block they touch: ``first`` word in the document, ``n`` words, ``times`` taken, ``some``, words taken once more, ``where``, bits of the shards."""
    times = drawn.groupBy(F.col("sid").alias("s"), F.col("block").alias("k")).agg(
        F.count_if("whole").alias("times"), F.sum(F.when(~F.col("whole"), F.col("words"))).alias("part"),
        F.bit_or(F.expr("shiftleft(1L, shard)")).alias("where"), F.bit_or(F.when(F.col("whole"), F.expr("shiftleft(1L, shard)"))).alias("whole_where"))
    pieces = _touching(placed, block)
    # Rows made by explode count as few in the planner's estimate; neither side is small.
    met = pieces.join(times.hint("merge"), (F.col("sid") == F.col("s")) & (F.col("block") == F.col("k")), "left")
    some = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("part", F.lit(0)) - F.col("at")))
    met = met.select(*placed.columns, "first", "n", F.coalesce("times", F.lit(0)).cast("int").alias("times"), some.alias("some"), "where", "whole_where")
    # A draw of a part of a block reaches only the documents in that part.
    return met.withColumn("where", F.coalesce(F.when(F.col("some") > 0, F.col("where")).otherwise(F.col("whole_where")), F.lit(0).cast("long"))).drop("whole_where")


def _placed(docs: DataFrame, text: str, weights: tuple[int, ...], budget: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Documents in their streams, and the sources."""
    t = text_of(text)
    narrow = docs.select("doc_id", "source", word_count(t).alias("size"), F.xxhash64(t, "source").alias("mark"))
    # Rows without words have no place of their own in the stream; a number keeps equal ones apart and spreads them.
    narrow = stored(narrow.withColumn("blank", F.when(F.col("size") == 0, F.monotonically_increasing_id())))
    sources = stored(targets(narrow, weights, budget, most))
    return streams(narrow, sources), sources


def _parts(docs: DataFrame, text: str, weights: tuple[int, ...], budget: float, most: float, block: int, seed: int) -> DataFrame:
    placed, sources = _placed(docs, text, weights, budget, most)
    return taken_pieces(placed, draws(sources, block, SHARDS, seed), block)


def mix(
    docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """Per document ``doc_id``, ``size``, ``source_size``, ``target`` of its source, ``taken``, words the mix takes of it, and the ``shards`` they go to."""
    parts = _parts(docs, text, weights, budget, most, block, seed)
    return parts.groupBy("doc_id", "size", "source_size", "target", "sid", "start", "mark", "blank").agg(
        F.sum(F.col("times") * F.col("n") + F.col("some")).cast("long").alias("taken"), F.bit_or("where").alias("where")
    ).select("doc_id", "size", "source_size", "target", "taken", F.expr(f"filter(sequence(0, {SHARDS - 1}), i -> bit_get(where, i) = 1)").alias("shards"))


def mixed_texts(
    docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """The mix as documents: each with the words taken of it, in order, and again for those taken once more.

    All columns stay, whatever their names. A take without words gives no row.
    """
    parts = _parts(docs, text, weights, budget, most, block, seed).where("times > 0 OR some > 0")
    takes = F.array_append(F.array_repeat(F.col("n"), F.col("times")), F.col("some"))
    parts = parts.select("doc_id", "mark", "sid", "start", "first", F.posexplode(takes).alias("pass", "n")).where("n > 0")
    cuts = parts.groupBy("doc_id", "mark", "sid", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("cuts"))
    body = text_of(text)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(body, "source").alias("same"), body.alias("body"))
    # Equal documents have their places in ``cuts`` each; one of them gives the text.
    met = rows.dropDuplicates(["id", "same"]).join(cuts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("same") == F.col("mark")))
    # A word with the white space behind it.
    tokens = F.regexp_extract_all(F.btrim("body", F.lit(SPACES)), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    met = once(met.select("row", "cuts", tokens.alias("split")), tokens=F.col("split"))
    pieces = F.transform("cuts", lambda c: F.array_join(F.slice("tokens", c["first"].cast("int") + 1, c["n"].cast("int")), ""))
    taken = F.btrim(F.array_join(pieces, ""), F.lit(SPACES))
    return met.select(*(taken.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
