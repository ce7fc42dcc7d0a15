"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tallygrove.llm import bpe, graph, linededup, mixing, neighbours, quality, quotes, sharding, simhash, suffixes, warc
from tallygrove.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id LONG, text STRING, source STRING, n_words INT, row STRING, size STRING, fp STRING, kept STRING, shard STRING, id STRING"


def _edge_rows():
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(lexicon) + ("\n" if rng.random() < 0.1 else "") for _ in range(n))

    shared, long_ = prose(120), prose(20_000)
    near = prose(300).split(" ")
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "word"), (5, long_), (6, shared), (7, shared), (7, shared), (8, prose(40) + shared + prose(40)),
        (9, prose(60) + "\n" + shared), (10, "a b c d e f g h i j " * 12), (11, "### $$$ " + prose(5)), (12, "Ünïcødé ΑΒΓ 東京 x " * 9),
        (None, prose(30)), (None, None), (13, " ".join(near)), (14, " ".join([*near[:150], "changed", *near[151:]])), (15, "one\ntwo\nthree\none\ntwo\nthree\n\n\n\n\n"),
        (16, "zero\none\ntwo\nthree\nfour"), (17, "\n\n\n\n"), (18, prose(9)), (19, "x" * 700), (20, "x" * 450 + "y"),
    ]
    return [(i, t, [None, "b", "a", "ä", ""][k % 5], k, "r", "s", "f", "k", "h", "d") for k, (i, t) in enumerate(texts)]


EDGE = _edge_rows()


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["edge", "given"])
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture
def none(edge):
    return edge.where("false")


def _pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---- 1 sharding ----


def test_shards(docs, none):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in _pairs(docs, "doc_id", "text"))
    got = sharding.shard(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for shard in range(5):
        mine = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 5) <= largest
    assert sharding.shard(none, 5).count() == 0


def test_overfull_ranges_are_divided(spark):
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(hot, 8)
    sizes = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 100


# ---- 2 line deduplication ----


def test_line_windows(docs, none):
    _same_as_line_by_line(docs)
    assert linededup.remove_repeats(none).count() == 0


def test_line_windows_of_repeated_ids(spark):
    a, b, c = "\n".join("abcde"), "\n".join("xcdey"), "\n".join("bcdcd")
    rows = [(1, a), (1, a), (1, a), (1, b), (2, c), (2, c), *[(None, a)] * 4, (None, b), (None, "p\nq\nr"), (None, "p\nq\nr"), (None, None), (None, None), (3, "p\nq\nr\ns")]
    docs = spark.createDataFrame([(i, t, "row", k % 3) for k, (i, t) in enumerate(rows)], "doc_id LONG, text STRING, row STRING, n INT").repartition(3)
    _same_as_line_by_line(docs)
    _same_as_line_by_line(docs.union(spark.createDataFrame([(9, a, "row", 0)] * 500, docs.schema)))


def test_line_windows_of_a_long_text(spark):
    lines = [f"line {k % 30_000}" for k in range(60_000)]
    _same_as_line_by_line(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[100:500]))], "doc_id LONG, text STRING"))


def _same_as_line_by_line(docs):
    rows = _pairs(docs, "doc_id", "text")

    def place(k):
        i, t = rows[k]
        code = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return i is None, i or 0, code - (code >> 63 << 64), k

    first, want = {}, Counter()
    for k in sorted(range(len(rows)), key=place):
        lines = (rows[k][1] or "").split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p : p + 3]), k)
    for k, (i, t) in enumerate(rows):
        if t is None:
            want[(i, None, 0)] += 1
            continue
        lines, gone, seen = t.split("\n"), set(), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not WORD.search("".join(w)):
                continue
            if w in seen or first[w] != k:
                gone.update(range(p, p + 3))
            seen.add(w)
        want[(i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))] += 1
    found = linededup.remove_repeats(docs)
    got = Counter((r.row["doc_id"], r.kept_text, len(r.removed)) for r in found.collect())
    assert got == want


# ---- 3 suffix deduplication ----


def _windows_twice(texts, n):
    return {w for w, k in Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1)).items() if k > 1}


def _cut(t, twice, n):
    covered = bytearray(len(t))
    for i in range(len(t) - n + 1):
        if t[i : i + n] in twice:
            covered[i : i + n] = b"\1" * n
    runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
    return len(t), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()


def test_repeated_strings(docs, none, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t in _pairs(docs, "doc_id", "text")]
    twice = _windows_twice([t for _, t in rows], 200)
    want = Counter((i, *_cut(t, twice, 200)) for i, t in rows)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(_pairs(suffixes.without_repeats(docs), *names)) == want
    # The way for very common anchors gives the same.
    monkeypatch.setattr(suffixes, "HOT_SEGMENTS", 1)
    assert Counter(_pairs(suffixes.without_repeats(docs), *names)) == want
    assert suffixes.without_repeats(none).count() == 0


@pytest.mark.parametrize("shard", [1, 3, 512])
def test_merged_transforms(shard, monkeypatch):
    monkeypatch.setattr(suffixes, "_SHARD", shard)
    rng, powers = random.Random(shard), suffixes._Powers()
    for length in (8, 12, 40):
        pool = bytes(rng.choice(b"ab") for _ in range(200)) + bytes(rng.randrange(256) for _ in range(200))
        bodies = list({pool[a : a + length + rng.randrange(40)] for a in (rng.randrange(300) for _ in range(20))})
        bodies = [b for b in bodies if len(b) >= length]
        twice = _windows_twice(bodies, length)
        want = [[b[i : i + length] in twice for i in range(len(b) - length + 1)] for b in bodies]
        assert [f.tolist() for f in suffixes.repeated_windows(bodies, length, powers)] == want


def test_long_texts_are_cut_into_stretches(monkeypatch):
    rng, powers = random.Random(5), suffixes._Powers()
    text = bytes(rng.randrange(97, 123) for _ in range(9000))
    whole = [s for s in suffixes.segments(text, 200, powers)]
    monkeypatch.setattr(suffixes, "_STRETCH", 1 << 10)
    parts = [s for s in suffixes.segments(text, 200, powers)]
    count = lambda found: sum(int(n.sum()) for _, _, _, n in found)
    assert len(whole) == 1 and len(parts) > 5 and count(whole) == count(parts) == 9000 - 199


# ---- 4 mixing ----


def test_mix(docs, none):
    rows = _pairs(docs, "doc_id", "source", "text")
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, rest, target = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        share = sum(weight[s] for s in left)
        full = [s for s in left if rest * weight[s] / share > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left.discard(s)
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
    target |= {s: rest * weight[s] / share for s in left}
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, len(WORD.findall(t or "")), sizes[s]) for i, s, t in rows)
    by_size = {}
    for s in names:
        by_size.setdefault((sizes[s], round(target[s], 6)), []).append(s)
    assert {(r.source_size, round(r.target, 6)) for r in got} <= set(by_size)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for k, same in by_size.items():
        assert abs(taken[k] - k[1] * len(same)) <= 0.5 * len(same) + 1e-6
    assert all(bool(r.shards) == (r.taken > 0) for r in got)
    assert Counter(map(str, mixing.mix(docs.repartition(7)).collect())) == Counter(map(str, got))
    assert mixing.mix(none).count() == 0


def test_mixed_texts_hold_the_words_taken(edge, none):
    taken = sum(r.taken for r in mixing.mix(edge).collect())
    mixed = mixing.mixed_texts(edge)
    assert mixed.columns == edge.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == taken
    words = {i: set(WORD.findall(t or "")) for i, t, *_ in EDGE}
    assert all(set(WORD.findall(r.text)) <= words[r.doc_id] for r in mixed.collect() if r.doc_id is not None)
    assert mixing.mixed_texts(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations(spark, n):
    df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("to"))
    to = [r.to for r in df.collect()]
    assert sorted(to) == list(range(n)) and (n < 10 or to != list(range(n)))


@pytest.mark.parametrize("shards", [1, 5, 64])
def test_slots_follow_shard_counts(given, shards):
    narrow = given.select("source", mixing.word_count(F.col("text")).alias("size"))
    sources = mixing.targets(narrow)
    counts = {(r.sid, r.shard): (r.first, r.n) for r in mixing.shard_counts(sources, shards=shards).collect()}
    drawn = mixing.draws(sources, shards=shards).collect()
    given_out = {}
    for r in drawn:
        given_out.setdefault((r.sid, r.shard), []).append(r.slot)
    assert {k: (min(v), len(v)) for k, v in given_out.items()} == counts and all(len(set(v)) == len(v) for v in given_out.values())
    for r in sources.collect():
        own = [d for d in drawn if d.sid == r.sid]
        assert sorted(d.slot for d in own) == list(range(len(own)))
        assert sum(d.words for d in own) == round(r.target) and sum(not d.whole for d in own) <= 1
        assert max(Counter(d.block for d in own).values(), default=0) <= 2
        if shards == 5 and len(own) > 100:  # each within six standard deviations of a fifth
            assert all(abs(counts[(r.sid, k)][1] - len(own) / 5) < 6 * (len(own) * 0.16) ** 0.5 for k in range(5))


def test_part_of_a_last_block(spark):
    data = [(1, "a", "w " * 5000), (2, "b", "v " * 900), (3, "c", "x " * 7), (4, "c", None)]
    docs = spark.createDataFrame(data, "doc_id LONG, source STRING, text STRING")
    got = mixing.mix(docs, weights=(8, 1, 1)).collect()
    assert all(abs(r.taken - r.target) <= 0.5 for r in got if r.doc_id != 4) and {r.taken for r in got if r.doc_id == 4} == {0}
    assert Counter(w for r in mixing.mixed_texts(docs, weights=(8, 1, 1)).collect() for w in r.text.split()) == {
        w: r.taken for r in got for w in ("wvx"[r.doc_id - 1 : r.doc_id],) if r.taken}


# ---- 5 byte-level BPE ----

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_tokens_and_round_trip(docs, none, reference):
    want = Counter()
    for i, t in _pairs(docs, "doc_id", "text"):
        ids = reference.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[(i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), packed)] += 1
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in found.collect())
    assert got == want
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_appends_and_edits(encoder, reference):
    rng = random.Random(2)
    for k in range(150):
        piece = bytes(rng.choice(b"abcdeth isn'") if k % 2 else rng.randrange(256) for _ in range(rng.randrange(1, 300)))
        table = encoder.table(piece)
        assert encoder.tokens_of(table) == reference._encode_single_piece(piece)
        more = bytes(rng.choice(b"the ") for _ in range(5))
        assert encoder.tokens_of(encoder.append(piece, list(table), more)) == reference._encode_single_piece(piece + more)
        start = rng.randrange(len(piece) + 1)
        end = min(len(piece), start + rng.randrange(4))
        changed, edited = encoder.edit(piece, table, start, end, b"th"[: k % 3])
        assert edited == encoder.table(changed)


# ---- 6 WARC ----


def test_archives(spark):
    page = "<p>" + "x" * 150
    rows = [(1, "http://a", "short"), (2, "http://b", "short"), (9, "http://c", page), (4, None, page), (7, "http://d\nx", page), (7, "http://d\nx", page), (5, "u", None), (6, "u", ""), (None, "n", page), (8, "é", "é" * 90)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumn("digest", F.lit("clash")).repartition(3)
    folder = warc.new_folder(pages)
    index = warc.write(pages, folder)
    found = warc.read(index, folder, payload=True).collect()
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and h == page and i != 4
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 4 if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert all(r.intact for r in found) and {r.url for r in found} == {"http://a", "http://b", "http://c", None, "http://d%0Ax", "u", "n", "é"}
    assert {r.page_id: r.payload.decode() for r in found if r.record_type == "response"} == {1: "short", 2: "short", 4: page, 5: "", 6: "", 8: "é" * 90}
    some = warc.read(index.where("page_id IN (1, 8)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [1, 8]
    assert warc.write(pages.where("false"), folder).count() == 0


def test_ranges_are_joined(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    assert [(s, n, len(h)) for s, n, h in warc._runs([(0, 20), (25, 20), (60, 10), (70, 60), (140, 200)])] == [(0, 45, 2), (60, 70, 2), (140, 200, 1)]


# ---- 7 SimHash ----


def _fingerprint(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_near_duplicates(docs, none, radius):
    rows = [(i, _fingerprint(t, 3)) for i, t in _pairs(docs, "doc_id", "text") if not t or len(t) < 50_000]
    docs = docs.where("text IS NULL OR length(text) < 50000")
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(rows[a][1] ^ rows[b][1]).count("1") <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(rows))
    assert Counter(_pairs(simhash.near_duplicates(docs, radius=radius), "doc_id", "fingerprint", "component_id")) == want
    assert simhash.near_duplicates(none, radius=radius).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    some = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    df = spark.createDataFrame([(x,) for x in signed], "fp LONG")
    for radius in (2, 3, 7):
        want = sorted((a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius)
        assert sorted(_pairs(simhash.links(df, radius), "a", "b")) == want


def test_distinct_texts(edge, none):
    kept = simhash.distinct_texts(edge.where("doc_id IS NULL OR doc_id <> 5"))
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # 1, 2, 3 and 17 have no words; 6 and 7 are equal; 14 is 13 with one word changed.
    assert ids[1] == 1 and ids[2] == ids[3] == ids[17] == 0 and ids[6] == 1 and ids[7] == 0 and ids[13] == 1 and ids[14] == 0
    assert all(ids[i] == 1 for i in (4, 8, 9, 10, 11, 12, 15, 16, 18, 19, 20)) and ids[None] == 1
    assert simhash.distinct_texts(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203), (300, 300)]
    links = spark.createDataFrame(chain, "a LONG, b LONG")
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert dict(_pairs(graph.components(links), "node", "root")) == want
    assert graph.components(links.where("false")).count() == 0


# ---- 8 quotation linking ----


def test_quotes(spark):
    mails = [
        (1, 0, "Hello all,\nshall we  meet?\n\nBest"), (1, 1, "> hello ALL,\n> shall we meet?\n\nYes."),
        (1, 2, "> > Hello all,\n> > shall we meet?\n\n> Yes.\n\nAt noon?"), (1, 3, ">> Yes.\n> At noon?\nFine\n> Unknown words"),
        (2, 0, "Hello all,\nshall we  meet?\n\nBest"), (2, 1, "> Best\n\nOther list"), (3, 0, None), (3, 1, ""), (3, 2, "> nothing known"),
        (4, 0, "> At noon?\n> \n> Other list\n\nbye"), (1, 1, "> hello ALL,\n> shall we meet?\n\nYes."),
    ]
    df = spark.createDataFrame(mails, "conv_id LONG, turn LONG, text STRING").withColumn("level", F.lit(1))
    got = quotes.conversations(df, ["conv_id", "turn"], ["conv_id"]).collect()
    by = {tuple(r.id): (r.parent and tuple(r.parent), tuple(r.root), r.depth, r.own) for r in got}
    assert len(got) == len(mails)
    assert by[(1, 0)] == (None, (1, 0), 0, "Hello all,\nshall we  meet?\n\nBest")
    assert by[(1, 1)] == ((1, 0), (1, 0), 1, "Yes.") and by[(1, 2)] == ((1, 1), (1, 0), 2, "At noon?")
    assert by[(1, 3)] == ((1, 2), (1, 0), 3, "Fine")
    assert by[(2, 0)][0] is None and by[(2, 1)] == ((2, 0), (2, 0), 1, "Other list")
    assert by[(3, 0)] == (None, (3, 0), 0, "") and by[(3, 2)] == (None, (3, 2), 0, "")
    assert by[(4, 0)][0] == (2, 1)  # the larger quote, of the other list
    assert quotes.conversations(df.where("false"), ["conv_id", "turn"]).count() == 0


def test_reply_order(spark):
    rng = random.Random(4)
    parent = {}
    for i in range(1, 400):  # threads of any shape, one message with many answers, one deep
        parent[i] = None if rng.random() < 0.05 else rng.choice([1, i - 1, rng.randrange(1, i)]) if i > 1 else None
    below = {}
    for i, p in sorted(parent.items()):
        below.setdefault(p, []).append(i)
    want = {}
    for root in below[None]:
        n, open_ = 0, [(root, 0)]
        while open_:
            i, depth = open_.pop()
            want[i] = (parent[i], root, depth, n)
            n += 1
            open_ += [(j, depth + 1) for j in reversed(below.get(i, []))]
    df = spark.createDataFrame(list(parent.items()), "id LONG, parent LONG").repartition(4)
    assert {r.id: (r.parent, r.root, r.depth, r.place) for r in quotes.threads(df).collect()} == want


def test_reply_order_of_branches(spark):
    mails = [(1, 0, "first"), (1, 1, "> first\n\nsecond"), (1, 2, "> first\n\nthird"), (1, 3, "> second\n\nfourth"), (1, 4, "long " * 40_000)]
    df = spark.createDataFrame(mails, "conv_id LONG, turn LONG, text STRING")
    got = {r.id.turn: (r.root.turn, r.place) for r in quotes.conversations(df, ["conv_id", "turn"]).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 3: (0, 2), 2: (0, 3), 4: (4, 0)}


def test_long_threads(spark):
    chain = spark.createDataFrame([(i, None if i == 0 else i - 1) for i in range(50)], "id LONG, parent LONG")
    assert {(r.root, r.depth) for r in quotes.threads(chain).collect()} == {(0, i) for i in range(50)}


# ---- 9 nearest neighbours ----


def test_nearest(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    m[40:80] = m[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (None, [1.0] * 16), (20, [2.0] * 16), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("id", F.lit("x")).repartition(3)
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = set()
    for i, q in usable:
        if i % 20 == 0:
            best = sorted((-neighbours.exact_products(v[None, :], q)[0], c) for c, v in usable if c != i and len(v) == len(q))
            want.add((i, tuple((c, -s) for s, c in best[:20])) if i != 20 else None)
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, 20, query_block=4, candidate_block=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert 1100 not in got
    for i, best in (w for w in want if w):
        if best:
            assert [(c, s) for _, c, s in got[i]] == list(best) and [r for r, _, _ in got[i]] == list(range(1, len(best) + 1))
    assert neighbours.nearest(df.where("false"), F.col("id") % 20 == 0, 20).count() == 0


# ---- 10 quality ----


def test_figures(docs, none):
    want = Counter()
    for i, t in _pairs(docs, "doc_id", "text"):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if count[x] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    judged = quality.judge(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(_pairs(judged, F.col("row.doc_id"), *(F.col(n) for n in names))) == want
    assert judged.where("base_failed AND kept").count() == 0
    assert quality.judge(none).count() == 0


def test_verdicts_against_labels(spark, given):
    judged = quality.judge(given).select("row.doc_id", "kept", "base_failed")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    met = judged.join(labels, "doc_id").collect()
    good = [r for r in met if r.quality == 1 and not r.base_failed]
    bad = [r for r in met if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_estimation():
    counts = {(1, 1, 1): 900, (-1, 1, 1): 40, (1, -1, -1): 30, (1, -1, 0): 20, (1, 1, 0): 10}
    model = quality.fit(counts)
    assert model.good((1, 1, 1)) > 0.99 and model.good((-1, 1, 1)) < 0.1 and model.good((1, -1, -1)) < 0.01
    rules = tuple(quality.Rule(n, "1", 0, 1) for n in "abc")
    assert all(0.9 < x <= 1 for x in quality.accuracies(model, counts, rules).values())
    assert quality.fit({}) is None


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
