"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else, in the same document or in
another. All is judged on the texts as they come in.

1. Anchors. Of the ``_GRAM``-byte strings inside every window of ``length`` bytes the one with the least hash is the
   window's anchor. Equal windows have equal anchors, so windows can only be equal within one anchor. Consecutive
   windows with the same anchor form a segment. Only segments whose anchor is there twice go on.
2. Equal segments are merged into one with a count; a count of two or more settles all its windows.
3. Segments of one anchor meet in one task. Parts of them (shards) each get a Burrows-Wheeler transform over symbols of
   ``length / 4`` bytes. The transforms are merged by refining the interleave of their suffixes: each round reads them in
   the order so far, and puts every suffix that precedes into the bucket of its symbol. Where two neighbours part in
   round r, they share r - 1 symbols. After four rounds, suffixes not parted share a whole window: the repeated
   intervals. No suffix of one shard is ever sorted against those of another.
4. An anchor with more distinct segments than ``HOT_SEGMENTS`` is not gathered in one task: its windows are counted one
   by one, by 128 bits of their content, which gives the same answer.

Texts are compared by 128 bits of their content and symbols by 64 bits within a task.

Defined results: a null text is empty; nothing goes from texts shorter than ``length``. Copies of a text of that length
or more go wholly, as each holds the other's strings. Ids are not looked at, so null and repeated ids do no harm. Long
texts are cut into overlapping stretches. An empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored, written
from .common import digest

LENGTH = 200
HOT_SEGMENTS = 30_000
_GRAM = 32
#: Windows of a long text that are looked at at once.
_STRETCH = 1 << 21
#: Segments that are merged at once, more only if one anchor has more; and segments of a shard.
_AT_ONCE = 4096
_SHARD = 512
_ROUNDS = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, longer as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


def _hashes(data: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes."""
    if len(data) < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int, powers: _Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch its offset, and the segments' anchor hashes, first windows and numbers of windows."""
    data = np.frombuffer(text, dtype=np.uint8)
    place_bits = np.uint64(_STRETCH * 2 - 1)
    for start in range(0, len(data) - length + 1, _STRETCH):
        part = data[start : start + _STRETCH + length - 1]
        h = _hashes(part, _GRAM, powers)
        places = np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_least((h & ~place_bits) | places, length - _GRAM + 1) & place_bits).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        yield start, h[anchor[first]].view(np.int64), first, np.diff(np.concatenate([first, [len(anchor)]]))


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """Places in the order of keys below 2^32, equal keys as they were: a plain sort of keys and places packed in one number."""
    packed = keys.astype(np.uint64) << np.uint64(32)
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _shard_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, then the second and so on."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        order = order[_stable_order(key[order])]
    return order


def repeated_windows(bodies: list[bytes], length: int, powers: _Powers) -> list[np.ndarray]:
    """For each segment, which of its windows are there again in it or in another."""
    step = length // _ROUNDS
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    # Suffixes of a segment start at each of its bytes and at its end.
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    total = int(base[-1])
    left = np.repeat(base[1:], sizes + 1) - 1 - np.arange(total)  # bytes in the suffix
    symbol = np.zeros(total, dtype=np.uint64)  # 0: shorter than a symbol
    full = left >= step
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    at = np.flatnonzero(full)
    symbol[at] = np.maximum(_hashes(data, step, powers)[at - owner[at]], np.uint64(1))
    ranks = (np.unique(symbol[at], return_inverse=True)[1] + 1).astype(np.uint32)
    code = np.zeros(total + length, dtype=np.uint32)
    code[at] = ranks
    keys = [np.where(left >= step * (r + 1), code[step * r : step * r + total], np.uint32(0)) for r in range(_ROUNDS)]
    whole = keys[3] > 0
    before = np.zeros(total, dtype=np.uint32)  # symbol that ends where the suffix starts
    before[at + step] = code[at]
    # Shards: sorted by themselves, each with its transform.
    cuts = [int(base[i]) for i in range(0, len(bodies), _SHARD)] + [total]
    order = np.concatenate([a + _shard_order([k[a:b] for k in keys]) for a, b in zip(cuts, cuts[1:], strict=False)])
    transform = before[order]
    shards = len(cuts) - 1
    shard_sizes = np.diff(cuts)
    ended = np.array([np.count_nonzero(~full[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
    interleave = np.repeat(np.arange(shards, dtype=np.uint16), shard_sizes)
    ends = np.repeat(np.arange(shards, dtype=np.uint16), ended)
    block = np.zeros(total, dtype=np.int32)
    shared = np.full(total, _ROUNDS, dtype=np.int8)  # symbols shared with the suffix before
    shared[0] = 0
    where = np.empty(total, dtype=np.int64)
    for r in range(1, _ROUNDS + 1):
        where[np.argsort(interleave, kind="stable")] = np.arange(total)
        symbols = transform[where]
        some = np.flatnonzero(symbols)
        dealt = some[_stable_order(symbols[some])]
        interleave = np.concatenate([ends, interleave[dealt]])
        parted = np.zeros(total, dtype=bool)
        parted[len(ends) + 1 :] = (symbols[dealt][1:] != symbols[dealt][:-1]) | (np.diff(block[dealt]) != 0)
        if len(ends) < total:
            parted[len(ends)] = True
        shared[parted & (shared == _ROUNDS)] = r - 1
        block = np.cumsum(parted, dtype=np.int32)
    where[np.argsort(interleave, kind="stable")] = np.arange(total)
    suffix = order[where]
    with_last = shared == _ROUNDS
    again = with_last.copy()
    again[:-1] |= with_last[1:]
    flags = np.zeros(total, dtype=bool)
    flags[suffix] = again
    flags &= whole
    return [flags[base[i] : base[i] + max(0, sizes[i] - length + 1)] for i in range(len(bodies))]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags as (first, number)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """The different anchors of each stretch of a text, and how often each is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            places, lists, times = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for row, text in enumerate(batch.column(2).cast(pa.large_binary())):
                for _, hashes, _, _ in segments(text.as_py(), length, powers):
                    different, count = np.unique(hashes, return_counts=True)
                    places.append(row)
                    lists.append(different)
                    times.append(count)
            ends = pa.array(np.cumsum([len(x) for x in lists]).astype(np.int32))
            at = pa.array(places, pa.int64())
            found = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (lists, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *found], names=["ta", "tb", "anchors", "times"])

    return texts.select("ta", "tb", "text").mapInArrow(run, "ta long, tb long, anchors array<long>, times array<long>")


def _bodies(texts: DataFrame, length: int) -> DataFrame:
    """Segments at the anchors listed, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, wanted = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), np.array(batch.column(3)[row].values)
                text = batch.column(2)[row].cast(pa.large_binary()).as_py()
                for start, hashes, first, count in segments(text, length, powers):
                    at = np.flatnonzero(np.isin(hashes, wanted))
                    if len(at):
                        begin = (first[at] + start).tolist()
                        body = [text[p : p + n + length - 1] for p, n in zip(begin, count[at].tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({
                            "ta": pa.array(np.full(len(at), a)), "tb": pa.array(np.full(len(at), b)), "anchor": pa.array(hashes[at]),
                            "start": pa.array(begin, pa.int64()), "n": pa.array(count[at]), "body": pa.array(body, pa.binary()),
                        })

    return texts.select("ta", "tb", "text", "anchors").mapInArrow(run, "ta long, tb long, anchor long, start long, n long, body binary")


def _merged(distinct: DataFrame, length: int) -> DataFrame:
    """Repeated windows (``first``, ``many``) of distinct segments (``sa``, ``sb``, ``anchor``, ``body``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = _Powers(), []

        def settle() -> pa.RecordBatch:
            flags = repeated_windows([h[3] for h in held], length, powers)
            rows = [(h[0], h[1], *span) for h, f in zip(held, flags, strict=True) for span in _spans(f)]
            names = ("sa", "sb", "first", "many")
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(held) >= _AT_ONCE and row[2] != held[-1][2]:
                    yield settle()
                    held.clear()
                held.append(row)
        if held:
            yield settle()

    dealt = distinct.select("sa", "sb", "anchor", "body").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "sa long, sb long, first long, many long")


def _counted(hot: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many distinct segments, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sa, sb, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(body) - length + 1
                keys = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_pydict({"sa": [sa] * n, "sb": [sb] * n, "first": pa.array(range(n), pa.int64()), "window": pa.array(keys, pa.binary())})

    windows = stored(hot.select("sa", "sb", "body").mapInArrow(run, "sa long, sb long, first long, window binary"))
    again = windows.groupBy("window").agg(F.count("*").alias("times")).where("times > 1")
    return windows.join(again, "window", "left_semi").select("sa", "sb", "first", F.lit(1).cast("long").alias("many"))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per text (``ta``, ``tb``, ``text``; all different) with a repeated string, ``spans`` of (first byte, end), merged."""
    texts = texts.where(F.octet_length("text") >= length)
    anchors = written(_anchors(texts, length), "anchors").select("ta", "tb", F.explode(F.arrays_zip("anchors", "times")).alias("x"))
    anchors = anchors.select("ta", "tb", F.col("x.anchors").alias("anchor"), F.col("x.times").alias("times"))
    twice = anchors.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    listed = anchors.drop("times").join(twice, "anchor", "left_semi").groupBy("ta", "tb").agg(F.collect_set("anchor").alias("anchors"))
    found = _bodies(texts.join(listed, ["ta", "tb"]), length)
    key = digest(F.col("body"))
    found = written(found.select("*", key["a"].alias("sa"), key["b"].alias("sb")), "segments")
    counts = stored(found.groupBy("sa", "sb").agg(F.count("*").alias("copies"), F.min("anchor").alias("anchor"), F.min("n").alias("n")))
    kinds = counts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    distinct = found.dropDuplicates(["sa", "sb"]).select("sa", "sb", "anchor", "body").join(kinds, "anchor")
    merged = _merged(distinct.where(F.col("kinds") <= HOT_SEGMENTS), length)
    if not kinds.where(F.col("kinds") > HOT_SEGMENTS).isEmpty():
        merged = merged.union(_counted(distinct.where(F.col("kinds") > HOT_SEGMENTS), length))
    # Segments with copies are repeated as a whole.
    several = counts.where("copies > 1").select("sa", "sb", F.lit(0).cast("long").alias("first"), F.col("n").alias("many"))
    windows = several.union(merged)
    met = found.select("ta", "tb", "sa", "sb", "start").join(windows, ["sa", "sb"])
    low = F.col("start") + F.col("first")
    return met.groupBy("ta", "tb").agg(F.sort_array(F.collect_set(F.struct(low.alias("low"), (low + F.col("many") + (length - 1)).alias("high")))).alias("spans"))


def _cut(rows: DataFrame) -> DataFrame:
    """``n_removed``, ``n_spans``, ``kept_sha256`` of texts with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"ta": [], "tb": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for row in range(batch.num_rows):
                text = batch.column(2)[row].cast(pa.large_binary()).as_py()
                kept, end, removed, runs = hashlib.sha256(), 0, 0, 0
                for span in batch.column(3)[row].as_py():
                    low, high = max(span["low"], end), span["high"]
                    if span["low"] > end or not runs:
                        kept.update(text[end : span["low"]])
                        runs += 1
                    if high > low:
                        removed += high - low
                        end = high
                kept.update(text[end:])
                for name, value in zip(out, (batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), removed, runs, kept.hexdigest()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("ta", pa.int64()), ("tb", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return rows.select("ta", "tb", "text", "spans").mapInArrow(run, "ta long, tb long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` of the bytes left."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = digest(body)
    rows = docs.select(F.col(key).alias("_id"), body.alias("text"), d["a"].alias("ta"), d["b"].alias("tb"))
    texts = written(rows.groupBy("ta", "tb").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts")
    spans = repeats(texts.select("ta", "tb", "text"), length)
    cut = _cut(texts.where("copies = 1").join(spans, ["ta", "tb"]))
    # Texts that are there several times go wholly, if they are long enough.
    n = F.octet_length("text")
    gone = (F.col("copies") > 1) & (n >= length)
    plain = texts.select("ta", "tb", n.cast("long").alias("n_bytes"), gone.alias("gone"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    judged = plain.join(cut, ["ta", "tb"], "left").select(
        "ta", "tb", "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return rows.select(F.col("_id").alias(key), "ta", "tb").join(judged, ["ta", "tb"]).drop("ta", "tb")
