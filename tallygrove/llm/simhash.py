"""SimHash near duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other are found exactly. Their 64 bits are ordered so that correlated
bits lie together and cut into parts. Every fingerprint gets its own threshold for each part, -1 (skip) upwards,
such that thresholds plus one sum to ``radius + 1``: whoever lies within ``radius`` of it lies within the threshold in
some part. Dynamic programming picks the thresholds with the fewest expected candidates, estimated from counts
of all fingerprints by byte of the ordered bits. Each fingerprint is filed under its value in every part and
probes the values within its thresholds; hits are verified on all bits inside the join.

Defined results: a null text is empty. Texts with fewer words than a shingle have one shingle of all their words,
texts without words the fingerprint zero, linked like any other. Copies and repeated rows share a fingerprint and
thus a component. Null ids take part, but name a component only where all its ids are null. An empty table gives
an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import release, stored, written
from .common import words
from .graph import components

BITS, UNITS, UNIT_BITS = 64, 8, 8
SEED = 42
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15
#: Expected cost of one probe, which is written, shuffled and sorted, in verified candidates.
_PROBE_COST = 300.0
#: Largest threshold of a part.
_MOST = 3
#: Fingerprints that the number of parts is chosen by; results do not depend on it.
TUNING_ROWS = 2000
#: Cells that the shingles of all texts are counted in, for the order of shingles, a power of two; results do not depend on it.
ORDER_CELLS = 1 << 18
#: Most bits of a text's parities, a power of two; longer texts share bits, which lets more pairs be compared.
_PARITY_BITS = 1 << 13
#: Codes of texts that a task remembers.
_RECENT = 1 << 17
#: Against rounding of bounds; lets more pairs be compared.
_SLACK = 1e-9


def fingerprint(data: bytes, width: int) -> int:
    """A bit is set if over half of the shingles' hashes, repeats included, have it set."""
    words = data.lower().split()  # bytes: A-Z only, and just the six white space characters
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[start : start + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long."""
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(x.as_py() or b"", width) for x in data]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "fp": pa.array(fps, pa.int64())})

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones each, highest bit first."""
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_order(distinct: DataFrame) -> list[int]:
    """Bits ordered so that each is followed by the one left that correlates most with those of its unit."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            x = _bits(batch.column(0).to_numpy()).astype(np.float64)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size, dtype=np.int32)), "n": pa.array(total.ravel())})

    # Always 65 x 65 sums, however many fingerprints.
    cells = distinct.mapInArrow(products, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((BITS + 1) ** 2)
    for row in cells:
        sums[row["cell"]] = row["n"]
    sums = sums.reshape(BITS + 1, BITS + 1)
    n = max(sums[BITS, BITS], 1.0)
    mean = sums[BITS, :BITS] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.abs(sums[:BITS, :BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread)
    left, order = set(range(BITS)), []
    while left:
        unit = [min(left, key=lambda b: (spread[b], b))]  # the least balanced bit starts a unit
        left.remove(unit[0])
        while len(unit) < UNIT_BITS:
            unit.append(max(left, key=lambda b: (related[b, unit].sum(), -b)))
            left.remove(unit[-1])
        order += unit
    return order


def _units(fps: np.ndarray, order: list[int]) -> np.ndarray:
    return np.packbits(_bits(fps)[:, order], axis=1)


def unit_counts(distinct: DataFrame, order: list[int]) -> np.ndarray:
    """How often each byte value is there in each unit of the ordered bits; always 8 x 256 counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((UNITS, 256), dtype=np.int64)
        for batch in batches:
            units = _units(batch.column(0).to_numpy(), order)
            for u in range(UNITS):
                total[u] += np.bincount(units[:, u], minlength=256)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size, dtype=np.int32)), "n": pa.array(total.ravel())})

    out = np.zeros(UNITS * 256)
    for row in distinct.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(UNITS, 256)


@dataclass(frozen=True)
class Plan:
    """How fingerprints are cut, filed and probed."""

    order: list[int]
    cuts: list[tuple[int, int]]
    nearby: np.ndarray  # expected share of fingerprints at each distance, by unit and byte
    total: float
    radius: int

    def thresholds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Threshold of each part for every fingerprint, and the expected cost."""
        n, goal = len(units), self.radius + 1
        best = np.full((n, goal + 1), np.inf)
        best[:, 0] = 0
        choices = []
        for first, last in self.cuts:
            width = (last - first) * UNIT_BITS
            # Units count as independent: distances within a part are sums of those within its units.
            chance = np.zeros((n, _MOST + 1))
            chance[:, 0] = 1
            for u in range(first, last):
                own, mixed = self.nearby[u][units[:, u]], np.zeros_like(chance)
                for d in range(_MOST + 1):
                    mixed[:, d:] += chance[:, : _MOST + 1 - d] * own[:, d : d + 1]
                chance = mixed
            found = np.cumsum(chance, axis=1) * self.total
            cost = [np.zeros(n)] + [found[:, t] + _PROBE_COST * len(_masks(width, t)) for t in range(_MOST + 1)]
            new, taken = np.full_like(best, np.inf), np.zeros((n, goal + 1), dtype=np.int8)
            for spent in range(min(_MOST + 1, goal) + 1):
                offer = best[:, : goal + 1 - spent] + cost[spent][:, None]
                better = offer < new[:, spent:]
                new[:, spent:] = np.where(better, offer, new[:, spent:])
                taken[:, spent:] = np.where(better, spent, taken[:, spent:])
            best = new
            choices.append(taken)
        left, out = np.full(n, goal), np.zeros((n, len(self.cuts)), dtype=np.int8)
        for p in range(len(self.cuts) - 1, -1, -1):
            spent = choices[p][np.arange(n), left]
            out[:, p] = spent - 1
            left = left - spent
        return out, best[:, goal]

    def values(self, units: np.ndarray, part: int) -> np.ndarray:
        first, last = self.cuts[part]
        wide = np.zeros((len(units), 8), dtype=np.uint8)
        wide[:, 8 - (last - first) :] = units[:, first:last]
        return wide.view(">u8").ravel().astype(np.uint64)


_KNOWN_MASKS: dict[tuple[int, int], np.ndarray] = {}


def _masks(width: int, threshold: int) -> np.ndarray:
    """All bit patterns of a width with at most so many bits set."""
    if (width, threshold) not in _KNOWN_MASKS:
        found = [sum(1 << b for b in at) for k in range(threshold + 1) for at in combinations(range(width), k)]
        _KNOWN_MASKS[width, threshold] = np.array(found, dtype=np.uint64)
    return _KNOWN_MASKS[width, threshold]


def plan(distinct: DataFrame, radius: int) -> Plan | None:
    """Order of bits, parts and estimates; None where there are no fingerprints."""
    order = bit_order(distinct)
    counts = unit_counts(distinct, order)
    total = counts[0].sum()
    if not total:
        return None
    apart = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
    nearby = np.stack([[(apart == d) @ (counts[u] / total) for d in range(_MOST + 1)] for u in range(UNITS)]).transpose(0, 2, 1)
    sample = np.array([r[0] for r in distinct.limit(TUNING_ROWS).collect()], dtype=np.int64)
    plans = []
    for parts in range(1, UNITS + 1):
        if parts * (_MOST + 1) < radius + 1:
            continue  # thresholds cannot add up
        edges = [round(i * UNITS / parts) for i in range(parts + 1)]
        p = Plan(order, list(zip(edges, edges[1:], strict=False)), nearby, total, radius)
        plans.append((p.thresholds(_units(sample, order))[1].mean(), parts, p))
    return min(plans)[2]


def _part_bits(cut: Plan, part: int) -> int:
    """The bits of a part, as a signed mask over fingerprints."""
    first, last = cut.cuts[part]
    mask = sum(1 << (BITS - 1 - bit) for bit in cut.order[first * UNIT_BITS : last * UNIT_BITS])
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fp``) that differ in 1 to ``radius`` bits, each once."""
    cut = plan(distinct, radius)
    if cut is None:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            units = _units(fps, cut.order)
            for p in range(len(cut.cuts)):
                yield _rows(p, cut.values(units, p), fps)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(start, 4096).to_numpy()
                units = _units(fps, cut.order)
                limits, _ = cut.thresholds(units)
                packed = ((limits.astype(np.int64) + 1) << (3 * np.arange(len(cut.cuts)))).sum(axis=1)
                for p, (first, last) in enumerate(cut.cuts):
                    values = cut.values(units, p)
                    for t in range(_MOST + 1):
                        if (at := limits[:, p] == t).any():
                            masks = _masks((last - first) * UNIT_BITS, t)
                            n = len(masks)
                            yield _rows(p, (values[at][:, None] ^ masks).ravel(), np.repeat(fps[at], n), np.repeat(packed[at], n))

    one = distinct.select("fp")
    index = one.mapInArrow(filed, "part int, value long, fp long")
    asked = one.mapInArrow(probes, "part int, value long, fp long, limits long")
    apart = F.col("q.fp").bitwiseXOR(F.col("i.fp"))
    fresh = F.lit(True)  # not found by an earlier part already
    for p in range(len(cut.cuts) - 1):
        limit = F.shiftright(F.col("q.limits"), 3 * p).bitwiseAND(F.lit(7)) - 1
        fresh = fresh & ((F.col("q.part") <= p) | (F.bit_count(apart.bitwiseAND(F.lit(_part_bits(cut, p)))) > limit))
    same = (F.col("q.part") == F.col("i.part")) & (F.col("q.value") == F.col("i.value")) & (F.col("q.fp") < F.col("i.fp"))
    near = (F.bit_count(apart) <= radius) & fresh
    return asked.alias("q").join(index.alias("i").hint("merge"), same & near).select(F.col("q.fp").alias("a"), F.col("i.fp").alias("b"))


def _rows(part: int, values: np.ndarray, fps: np.ndarray, limits: np.ndarray | None = None) -> pa.RecordBatch:
    columns = {"part": pa.array(np.full(len(fps), part, dtype=np.int32)), "value": pa.array(values.view(np.int64)), "fp": pa.array(fps)}
    return pa.RecordBatch.from_pydict(columns | ({} if limits is None else {"limits": pa.array(limits)}))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Per document ``key``, ``fingerprint`` in hexadecimal and ``component_id``, the smallest id reachable over links."""
    prints = stored(fingerprints(docs, key, text, width))
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("least")))
    found = components(links(distinct, radius))
    linked = found.join(distinct, found["node"] == distinct["fp"])
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = distinct.join(
        found.join(named, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left"
    ).select("fp", F.coalesce("component_id", "least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(by_print, "fp").select(key, hexed, "component_id")


#: A-Z and their lower case, as the fingerprints take them.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_shingles(texts: DataFrame, text: str, width: int) -> DataFrame:
    """The texts with ``s``: distinct hashes of the runs of ``width`` words; of all words, where they are fewer; none for a blank text."""
    split = texts.select("*", words(F.translate(text, _UPPER, _LOWER)).alias("_split")).drop(text)
    w = once(split, _w=F.col("_split")).drop("_split")
    places = F.sequence(F.lit(1), F.greatest(F.size("_w") - (width - 1), F.lit(1)))
    runs = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice("_w", i, width))))
    return w.select("*", F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(runs).alias("s")).drop("_w")


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """Distinct hashes, in order, of the runs of ``width`` words; of all words, where they are fewer; none for a blank text."""
    words = data.lower().split()  # bytes: A-Z only, and just the six white space characters
    if not words:
        return np.zeros(0, dtype=np.int64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(each))
    n = len(each) - width + 1
    mixed = np.full(n, SEED, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _each_text(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Code and shingles of the texts in a task; a copy of a recent one is passed over."""
    recent: set[int] = set()
    for batch in batches:
        for code, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            if code not in recent:
                if len(recent) >= _RECENT:
                    recent.clear()
                recent.add(code)
                yield code, shingle_hashes(body.as_py(), width)


def _in_batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= _CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Longs whose bits tell, for every rest of the shingles by the number of bits, if an odd number of shingles has it.

    A shingle that only one of two texts has turns one bit, so texts differ in at least as many shingles as bits. There
    are about as many bits as shingles; those of twice the number fold into fewer, as rests do.
    """
    n = min(_PARITY_BITS, max(64, 1 << max(0, len(shingles) - 1).bit_length()))
    odd = np.bincount(shingles & (n - 1), minlength=n).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def profiles(texts: DataFrame, width: int, words_each: int) -> DataFrame:
    """Of texts (``who`` with ``code``, ``body``), in one pass over them: a row per text with ``fp``, ``n``, its different shingles of
    ``words_each`` words, and their ``parity``; and rows without ``who`` that count, by ``cell``, the shingles of a task's different texts."""
    cells = ORDER_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n_waiting, recent = np.zeros(cells, dtype=np.int64), [], 0, set()
        who_type = None
        for batch in batches:
            who_type = batch.schema.field(0).type
            bodies = batch.column(1).cast(pa.large_binary())
            fps, sizes, odd = [], [], []
            for code, body in zip(batch.column(0).field("code").to_pylist(), bodies, strict=True):
                data = body.as_py()
                s = shingle_hashes(data, words_each)
                fps.append(fingerprint(data, width))
                sizes.append(len(s))
                odd.append(parities(s))
                if code not in recent:
                    if len(recent) >= _RECENT:
                        recent.clear()
                    recent.add(code)
                    waiting.append(s & (cells - 1))
                    n_waiting += len(s)
                    if n_waiting >= cells:
                        total += np.bincount(np.concatenate(waiting), minlength=cells)
                        waiting, n_waiting = [], 0
            if fps:
                none = pa.nulls(len(fps), pa.int64())
                yield _profiled(batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), none.cast(pa.int32()), none)
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=cells)
        used = np.flatnonzero(total)
        for start in range(0, len(used), _CHUNK):
            at = used[start : start + _CHUNK]
            k = len(at)
            yield _profiled(pa.nulls(k, who_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64())), pa.array(at, pa.int32()), pa.array(total[at]))

    who = texts.schema["who"].dataType.simpleString()
    return texts.select("who", "body").mapInArrow(run, f"who {who}, fp long, n int, parity array<bigint>, cell int, times long")


def _profiled(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["who", "fp", "n", "parity", "cell", "times"])


def cell_counts(profiled: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall in each cell; always ``ORDER_CELLS`` counts."""
    out = np.zeros(ORDER_CELLS, dtype=np.int64)
    found = profiled.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    out[found["cell"].to_numpy()] = found["times"].to_numpy()
    return out


def prefixes(bodies: DataFrame, often: np.ndarray, width: int, similarity: float) -> DataFrame:
    """Per text (``code``, ``body``) its first shingles, rarest cell first: ``shingle``, ``code``, ``at``, its place, and ``n``, shingles of the text.

    Texts with a Jaccard similarity of ``similarity`` or more have one of them in common, whatever order all texts share.
    Blank texts have one row with ``n`` 0.
    """
    last = len(often) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for code, s in _each_text(batches, width):
                n = len(s)
                s = s[np.argsort(often[s & last], kind="stable")]
                first = s[: n - math.ceil(similarity * n - _SLACK) + 1] if n else np.zeros(1, dtype=np.int64)
                yield first, np.full(len(first), code), np.arange(len(first), dtype=np.int32), np.full(len(first), n, dtype=np.int32)

        return _in_batches(rows(), ["shingle", "code", "at", "n"])

    return bodies.mapInArrow(run, "shingle long, code long, at int, n int")


def _may_be_alike(n: str, parity: str, other_n: str, other_parity: str, similarity: float) -> Column:
    """If sizes and parities of two texts leave room for the similarity; true for all that have it."""
    p, q = F.col(parity), F.col(other_parity)
    k = F.least(F.size(p), F.size(q))

    def folded(x: Column) -> Column:  # alike sizes differ by less than two, so there is one half to fold at most
        halves = F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > k, halves).otherwise(x)

    turned = F.aggregate(F.zip_with(folded(p), folded(q), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    both = F.col(n) + F.col(other_n)
    sized = F.least(n, other_n) >= F.lit(similarity) * F.greatest(n, other_n) - _SLACK
    # With similarity t the texts differ in (1 - t) / (1 + t) of their shingles, one by one, at most.
    return F.when(sized, turned <= F.lit((1 - similarity) / (1 + similarity)) * both + _SLACK).otherwise(F.lit(False))


def _plausible(pairs: DataFrame, texts: DataFrame, similarity: float, by: str = "mark") -> DataFrame:
    """Of pairs ``a``, ``b`` (marks or codes) those of different groups that may be alike, as pairs ``x``, ``y`` of marks with their groups ``rx``, ``ry``."""
    left = texts.select(F.col(by).alias("a"), F.col("mark").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("parity").alias("px"))
    right = texts.select(F.col(by).alias("b"), F.col("mark").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("parity").alias("py"))
    met = pairs.join(left, "a").join(right, "b").where("rx != ry")
    return met.where(_may_be_alike("nx", "px", "ny", "py", similarity)).select("x", "y", "rx", "ry")


def _alike(pairs: DataFrame, marked: DataFrame, words_each: int, similarity: float) -> DataFrame:
    """Of pairs ``x``, ``y`` of marks, all columns, those whose sets of shingles have the similarity."""
    pairs = stored(pairs)
    # A table, so that the planner knows its size: texts are not shuffled for a short list.
    involved = written(pairs.select(F.col("x").alias("_m")).union(pairs.select("y")).distinct(), "compared")
    # Sets only of texts that have a candidate, once per text.
    bodies = marked.select("_mark", "_body").join(involved, F.col("_mark") == F.col("_m"), "left_semi").dropDuplicates(["_mark"])
    sets = stored(with_shingles(bodies.select(F.col("_mark").alias("mark"), F.col("_body").alias("body")), "body", words_each))
    left, right = sets.select(F.col("mark").alias("x"), F.col("s").alias("sx")), sets.select(F.col("mark").alias("y"), F.col("s").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    every = F.size("sx") + F.size("sy") - both
    return stored(pairs.join(left, "x").join(right, "y").where((every == 0) | (both >= F.lit(similarity) * every)).select(*pairs.columns))


def _grouped(texts: DataFrame, alike: DataFrame) -> DataFrame:
    """Texts with ``root``, the name of their group, the least mark in it, once groups with texts that are alike are one.

    Only names of groups are linked: what earlier links joined is not gone through again.
    """
    groups = components(alike, "rx", "ry").withColumnRenamed("root", "_new")
    own = [c for c in texts.columns if c != "root"]
    return texts.join(groups, F.col("root") == F.col("node"), "left").select(*own, F.coalesce("_new", "root").alias("root"))


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Rows of ``prefixes`` whose shingle several texts have, each text once, with ``first``, the least text of the shingle.

    The least and the largest text of a shingle come from an aggregation, combined in each task, and rows meet them in
    a join that adaptive execution splits, so a shingle that a third of all texts has is in no single task.
    """
    place = F.struct("code", "n", "at")
    ends = rows.groupBy(F.col("shingle").alias("t")).agg(F.min(place).alias("first"), F.max("code").alias("last"))
    ends = written(ends.where("first.code != last").drop("last"), "ends")
    return rows.join(ends, F.col("shingle") == F.col("t")).select("shingle", "code", "at", "n", "first")


def _fits(n: str, at: str, other_n: str, other_at: str, similarity: float) -> Column:
    """If the shingles from a common one on are enough for the similarity."""
    left = F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))
    return left >= F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(other_n)) - _SLACK


def _with_first(shared: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of marks: each text with the first text that shares a shingle, if they may be alike and are not of one group already."""
    fits = _fits("n", "at", "first.n", "first.at", similarity)
    pairs = shared.where((F.col("code") != F.col("first.code")) & fits).select(F.col("first.code").alias("a"), F.col("code").alias("b")).distinct()
    return _plausible(pairs, texts, similarity, "code")


def _between_groups(shared: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """All pairs of marks that share a shingle, may be alike by their places in it, and are of different groups.

    Texts outside the most frequent group of a shingle meet all others; that group's texts do not meet each other.
    """
    own = texts.select(F.col("code").alias("c"), "mark", "root")
    rows = stored(shared.join(own, F.col("code") == F.col("c")).select("shingle", "at", "n", "mark", "root").dropDuplicates(["shingle", "mark"]))
    counts = rows.groupBy("shingle", "root").agg(F.count("*").alias("m"))
    main = counts.groupBy(F.col("shingle").alias("t")).agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = stored(rows.join(main, F.col("shingle") == F.col("t")).drop("t", "kinds"))
    a, b = rows.where("root != main").alias("a"), rows.alias("b")
    once_each = (F.col("b.root") == F.col("b.main")) | (F.col("a.mark") < F.col("b.mark"))
    fits = _fits("a.n", "a.at", "b.n", "b.at", similarity)
    met = a.join(b.hint("merge"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & once_each & fits)
    pairs = met.select(F.least("a.mark", "b.mark").alias("a"), F.greatest("a.mark", "b.mark").alias("b")).distinct()
    return _plausible(pairs, texts, similarity)


def distinct_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 6, width: int = 3, words_each: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The documents, all columns, that stay when of each group of near duplicates the one with the smallest id stays.

    Texts are linked if their sets of ``words_each`` words have a Jaccard similarity of ``similarity`` or more; groups are
    connected over links. The groups are those that comparing all texts would give, in three steps. Texts whose
    fingerprints (of ``width`` words) lie within ``radius`` bits, the first text standing for its fingerprint, are
    compared, which joins most of a large group of near copies. Each text's rarest shingles, as many as leave none
    without one in common with a text alike, are then shared shingles: every text is compared with the first that has the
    shingle, and after that with all that have it and are not of its group. The fingerprints and the order of shingles,
    by counts of all texts in a fixed number of cells, change what is compared, not the result. Pairs whose parities of
    shingles differ in too many bits are not alike and are passed over before any set is built.

    Nulls and empty texts are texts without words, of which all are one group. A null id is larger than any other; rows of
    one text with the same id, or all without, stay together, repeated rows too. Ties go to the text of smallest hash. A
    very long text is read whole; its row, its set and each set it is compared with must fit in a task. An empty table
    gives an empty result; columns of other names are kept as they are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # 128 bits stand for a text.
    mark = F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32))
    marked = docs.select(F.struct("*").alias("row"), F.col(key).alias("_id"), body.alias("_body"), mark.alias("_mark"))
    who = F.struct(F.col("_id").alias("id"), F.col("_mark").alias("mark"), F.xxhash64("_body").alias("code")).alias("who")
    seen = stored(profiles(marked.select(who, F.col("_body").alias("body")), width, words_each))
    often = cell_counts(seen)
    each = seen.where("cell is null").groupBy("who.mark").agg(
        F.min("who.id").alias("least"), *(F.min(c).alias(n) for c, n in (("fp", "fp"), ("who.code", "code"), ("n", "n"), ("parity", "parity")))
    )
    texts = stored(each.withColumn("root", F.col("mark")))
    first = stored(texts.groupBy("fp").agg(F.min("mark").alias("first"), F.count("*").alias("n")))
    near = links(first.select("fp"), radius)
    across = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    within = texts.join(first.where("n > 1").select(F.col("fp").alias("f"), "first"), F.col("fp") == F.col("f")).where("mark != first").select(F.col("first").alias("x"), F.col("mark").alias("y"))
    texts = texts.drop("fp")
    alike = _alike(_plausible(across.union(within).toDF("a", "b"), texts, similarity), marked, words_each, similarity)
    del seen, first, near, across, within
    release(docs.sparkSession)

    bodies = marked.select(F.xxhash64("_body").alias("code"), F.col("_body").alias("body"))
    shared = stored(shared_prefixes(prefixes(bodies, often, words_each, similarity)))
    for candidates in (_with_first, _between_groups):
        release(docs.sparkSession)
        texts = stored(_grouped(texts, alike))
        alike = _alike(candidates(shared, texts, similarity), marked, words_each, similarity)
    del shared
    release(docs.sparkSession)
    ranked = _grouped(texts, alike)
    best = ranked.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "mark")).alias("best"))
    stay = best.select(F.col("best.mark").alias("m"), F.col("best.least").alias("i"))
    return marked.join(stay, (F.col("_mark") == F.col("m")) & F.col("_id").eqNullSafe(F.col("i"))).select("row.*")
