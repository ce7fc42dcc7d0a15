"""Importance resampling towards a target distribution, over hashed features of one and two words.

Words found often are a dictionary, each bounded by delimiters, in an Aho-Corasick automaton whose payload names the word's CRC
and length. One scan of a text emits the payloads of its words in order; words outside the dictionary, seen as gaps between the
matches, get theirs on the spot. A CRC of two words and the space between follows from the two payloads alone, since a CRC
moves over n more bytes by a linear map. Buckets of every document are written once and read for both counting and scoring:
bucket totals of corpus and target give each bucket's gain, the mean gain of a document is its weight, and a score adds noise
that depends on the document's id alone, so that the highest scores are a draw by weight without replacement.

The dictionary only saves work: it holds ``DICTIONARY`` words out of about ``SAMPLE`` rows with the smallest hashes of their ids
and changes no result. Counts, gains and scores are over all rows. Ranks come from a histogram of scores, of which there are at most
some hundred thousand as they are whole thousandths of logarithms, and from bitmaps of ids within a score (see ``bitmaps``).

Defined results: a null text has no words. A document without words has weight 0. A null id is hashed as the empty text and
comes first among equal scores. Rows of equal score and id are ranked by their number of features; if that is equal too, they
are alike in all columns of the result. Long texts are scanned whole. Repeated rows count and are drawn each. Without documents
there are no rows; without targets all target counts are 0. Other columns are ignored and none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored, written
from .bitmaps import places

BUCKETS = 10_000
DICTIONARY = 50_000
SAMPLE = 5_000
#: Bytes of text scanned at once; a longer text is scanned alone.
_AT_ONCE = 2_000_000
_LONGEST = 64

#: Upper-case ASCII letters become lower-case, other ASCII characters that are no digits or letters become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@cache
def _one_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


@cache
def _power(k: int) -> np.ndarray:
    """What 2 to the power k zero bytes do to each byte of a CRC, as four tables that are added by XOR."""
    if k == 0:
        low = np.arange(256, dtype=np.uint32)
        return np.stack([_one_byte(), low, low << np.uint32(8), low << np.uint32(16)])
    half = _power(k - 1)
    return np.stack([_through(half, t) for t in half])


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def advanced(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved over the given numbers of bytes."""
    k = 0
    while (left := lengths >> k).any():
        odd = np.flatnonzero(left & 1)
        crc = crc.copy()
        crc[odd] = _through(_power(k), crc[odd])
        k += 1
    return crc


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two strings in a row, from the CRC of each and the second's length."""
    return advanced(first, length) ^ second


class Scanner:
    """Payloads (CRC, length in bytes) of the words of texts."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        self.crcs = np.array([crc32(w) for w in words], dtype=np.uint32)
        if words:
            self.automaton.make_automaton()

    def payloads(self, plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text of words and spaces, with a space at either end: end, CRC and length of each word, in order."""
        space = np.frombuffer(plain, np.uint8) == 32
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        crcs, known = np.zeros(len(ends), np.uint32), np.zeros(len(ends), bool)
        if len(self.crcs):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(plain.decode("latin-1"))), np.int64)
            at = np.searchsorted(ends, found[0::2])
            crcs[at] = self.crcs[found[1::2]]
            known[at] = True
        for i in np.flatnonzero(~known):
            crcs[i] = crc32(plain[starts[i] : ends[i]])
        return ends, crcs, ends - starts


def plain_text(text: bytes) -> bytes:
    return text.translate(_PLAIN)


def buckets_of(scanner: Scanner, texts: list[bytes], buckets: int = BUCKETS) -> list[tuple[int, np.ndarray]]:
    """Number of words and buckets of the features of each text; texts are scanned in one go."""
    plain = b" " + b" ".join(map(plain_text, texts)) + b" "
    borders = np.cumsum([1 + len(t) for t in texts])
    ends, crcs, lengths = scanner.payloads(plain)
    last = np.searchsorted(ends, borders, side="right")
    space = np.full(max(len(crcs) - 1, 0), crc32(b" "), np.uint32)
    spaced = composed(space, crcs[1:], lengths[1:])
    pairs = composed(crcs[:-1], spaced, lengths[1:] + 1)
    single, double = (crcs % buckets).astype("<u4"), (pairs % buckets).astype("<u4")
    out, first = [], 0
    for end in last:
        out.append((int(end - first), np.concatenate([single[first:end], double[first : max(end - 1, first)]])))
        first = end
    return out


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 65536 else "<u4"


def _scanned(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # kept by the worker from task to task
        if "scanner" not in state:
            state["scanner"] = Scanner(state["words"])
        for batch in batches:
            texts, ids, at = batch.column(1), batch.column(0), 0
            while at < len(texts):
                part, size, first = [], 0, at
                while at < len(texts) and (not part or size < _AT_ONCE):
                    part.append((texts[at].as_py() or "").encode())
                    size += len(part[-1])
                    at += 1
                found = buckets_of(state["scanner"], part, buckets)
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(first, at - first), "n_words": pa.array([n for n, _ in found], pa.int64()),
                    "buckets": pa.array([b.astype(_width(buckets)).tobytes() for _, b in found], pa.binary())})

    return run


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), _width(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    return run


def _weighed(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.array(shared.value, np.int64)
        for batch in batches:
            features = [np.frombuffer(v.as_buffer(), _width(buckets)) for v in batch.column(2)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "n_words": batch.column(1), "n_features": pa.array([len(f) for f in features], pa.int64()),
                "weight": pa.array([int(gains[f].sum()) // len(f) if len(f) else 0 for f in features], pa.int64())})

    return run


def frequent_words(texts: DataFrame, text: str, order: Column, rows: int = SAMPLE, words: int = DICTIONARY) -> list[bytes]:
    """The words met most often in about ``rows`` texts, those with the smallest ``order``: at most ``words``, of at most 64 bytes each.

    Numbers alone are sorted for the border; texts stay in their tasks, and only words are shuffled, counted.
    """
    numbered = texts.select(F.col(text).alias("t"), order.alias("o"))
    border = numbered.select("o").orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    some = numbered.where(F.col("o") <= F.lit(border))
    low = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = F.explode(F.split(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "))
    met = some.select(word.alias("w")).where(F.octet_length("w").between(1, _LONGEST)).groupBy("w").count()
    return [r.w.encode() for r in met.orderBy(F.desc("count"), "w").limit(words).collect()]


def scan(texts: DataFrame, key: str, text: str, shared, buckets: int) -> DataFrame:
    """``id``, ``n_words`` and packed ``buckets`` of every text, written once."""
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(_scanned(shared, buckets), f"id {kind}, n_words long, buckets binary"), "buckets")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket in thousandths, from ``bucket`` and ``n`` of corpus and target; at most ``buckets`` rows are collected."""
    counts = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), *(F.lit(0).cast("long").alias(c) for c in "st"))
    both = counts.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = Window.partitionBy()
    sums = both.select("*", F.sum("s").over(total).cast("double").alias("all_s"), F.sum("t").over(total).cast("double").alias("all_t"))
    ratio = (F.col("t") + F.lit(1.0)) * (F.col("all_s") + F.lit(float(buckets))) / ((F.col("s") + F.lit(1.0)) * (F.col("all_t") + F.lit(float(buckets))))
    return [r.gain for r in sums.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")).orderBy("bucket").collect()]


def noise(key: str, seed: int) -> Column:
    """Thousandths of a standard Gumbel value that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text",
    target_text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """Every document's ``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where it is not drawn)."""
    spark = docs.sparkSession
    words = frequent_words(docs, text, F.xxhash64(key))
    shared = spark.sparkContext.broadcast({"words": words})
    scanned = scan(docs, key, text, shared, buckets)
    aims = scan(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, shared, buckets)

    def counted(df: DataFrame) -> DataFrame:
        parts = df.select("buckets").mapInArrow(_counted(buckets), "bucket int, n long")
        return parts.groupBy("bucket").agg(F.sum("n").alias("n"))

    worth = spark.sparkContext.broadcast(gains(counted(scanned), counted(aims), buckets))
    kind = scanned.schema["id"].dataType.simpleString()
    scored = stored(
        scanned.mapInArrow(_weighed(worth, buckets), f"id {kind}, n_words long, n_features long, weight long")
        .withColumn("score", F.col("weight") + noise("id", seed)))
    return ranked(scored, percent, min_words).withColumnRenamed("id", key)


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """The rows with ``rank``: of those with enough words, the given share of highest scores is numbered from 1."""
    fit = scored.where(F.col("n_words") >= min_words)
    ahead = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    # Bounded: a row per whole score.
    by_score = stored(fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("score").alias("_score"), "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_above")))
    total = by_score.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    reached = by_score.where(F.col("_above") < drawn)
    near = stored(fit.join(reached.drop("n"), F.col("score") == F.col("_score")).drop("_score"))
    found = places(near, ["score"], ["id", "n_features"])
    rank = F.col("_above") + F.col("_place") + 1
    rows = found.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    least = reached.agg(F.min("_score")).first()[0]
    reaches = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(least))
    return rows.unionByName(scored.where(~F.coalesce(reaches, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
