"""Shards of near equal size from sampled splitters.

Records get a key of 64 bits: 40 from their text, so that copies lie together, and 24 from their id, so that any number
of copies can still be divided. Keys are sampled in proportion to size, splitters are taken at equal weights
of the sample, and records are dealt to the ranges between splitters. Ranges that turn out overfull are sampled
and divided again. Sizes summed within and over ranges then place every record exactly: shard i takes the
records whose middle byte lies in the i-th equal share of all bytes.

Defined results: a null text counts no bytes, and every record counts ``overhead`` more, so empty texts have a size
too. Repeated rows are placed one by one, ties in any order as they are alike. Null ids are allowed. An empty table
gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import running_before

OVERHEAD = 16
RANGES_PER_SHARD = 8
#: Rows that a range should hold; the number of ranges follows the rows.
RANGE_ROWS = 500_000
#: Sampled keys per range; the sample is bounded by this times the number of ranges.
SAMPLES_PER_RANGE = 32
#: A range is overfull at this many times its share of bytes or rows.
OVERFULL = 2.0
ROUNDS = 4

_ID_BITS = (1 << 24) - 1


def _ranged(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Records with ``range``, the number of splitters at or below their key."""
    names = [c for c in records.columns if c != "range"]
    records = records.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.searchsorted(splitters, batch.column(names.index("_key")).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], names=[*names, "range"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{schema}, range int")


def _sample(records: DataFrame, weight: float, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with a chance in proportion to size, one for each ``weight`` bytes, and the bytes each stands for."""
    chance = F.least(F.lit(1.0), F.col("_size") / F.lit(weight))
    drawn = F.shiftrightunsigned(F.xxhash64("_key", "_id", F.lit(round_)), 11) / F.lit(float(1 << 53))
    rows = records.where(drawn < chance).select("_key", (F.col("_size") / chance).alias("w")).collect()
    rows.sort()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows])


def _splitters(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Keys at the quantiles of the weighted sample."""
    if not len(keys):
        return keys
    ends = np.cumsum(weights)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def ranges(records: DataFrame, wanted: int) -> DataFrame:
    """Records (``_key``, ``_id``, ``_size``) with ``range``; stored."""
    n, total = records.agg(F.count("*"), F.sum("_size")).first()
    if not n:
        return records.select("*", F.lit(0).alias("range"))
    splitters = _splitters(*_sample(records, total / (wanted * SAMPLES_PER_RANGE), 0), wanted)
    for round_ in range(1, ROUNDS + 1):
        dealt = stored(_ranged(records, splitters))
        full = {
            r["range"]: max(r["bytes"] * wanted / total, r["rows"] * wanted / n)
            for r in dealt.groupBy("range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
        }
        heavy = [r for r, load in full.items() if load > OVERFULL]
        if not heavy or round_ == ROUNDS:
            break
        # Only records of overfull ranges are drawn from, twice as densely in each round.
        keys, weights = _sample(dealt.where(F.col("range").isin(heavy)), total / (wanted * SAMPLES_PER_RANGE << round_), round_)
        place = np.searchsorted(splitters, keys, side="right")
        more = [_splitters(keys[place == r], weights[place == r], int(np.ceil(full[r])) + 1) for r in heavy]
        finer = np.unique(np.concatenate([splitters, *more]))
        if len(finer) == len(splitters):
            break  # a single key, which running sums divide
        splitters = finer
    return dealt


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Per record ``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (its place in the shard) and ``grown_shard`` (null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    records = stored(
        docs.select(
            F.col(key).alias("_id"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("_size"),
            F.crc32(body).alias("_crc"),
            F.xxhash64(body).bitwiseAND(F.lit(~_ID_BITS)).bitwiseOR(F.xxhash64(key).bitwiseAND(F.lit(_ID_BITS))).alias("_key"),
        )
    )
    n, total = records.agg(F.count("*"), F.sum("_size")).first()
    dealt = ranges(records, max(RANGES_PER_SHARD * shards, -(-n // RANGE_ROWS)))
    order = [F.col(c) for c in ("_key", "_id", "_crc", "_size")]
    placed = running_before(dealt.withColumn("_one", F.lit(1).cast("long")), [], "range", order, before="_size", place="_one")
    middle = F.col("before") + F.col("_size") / 2
    number = F.least(F.floor(middle * F.lit(shards) / F.lit(total or 1)), F.lit(shards - 1)).cast("int")
    placed = stored(placed.select("*", number.alias("shard")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    # Bounded: one row per shard.
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
