"""Manifest, resampling and license scan against brute force, on nulls, empty and long texts, ties, repeated rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import bitmaps, licenses, merkle, mixing, resampling
from tallygrove.llm.signatures import BASE, CONFIDENCE, RULES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- bitmaps ----


def test_places_of_sparse_repeated_and_null_keys(spark):
    rng = random.Random(1)
    keys = [None, -(2**63), 2**63 - 1, -1, 0, 63, 64, 4095, 4096, 2**40, *range(3000, 9000, 7), *(rng.randrange(-(2**62), 2**62) for _ in range(200))]
    rows = [(rng.choice([None, "a", "a", "b"]), rng.choice(keys), rng.randrange(4)) for _ in range(4000)] + [("a", 5, 1)] * 500
    found = bitmaps.places(spark.createDataFrame(rows, "g string, k long, second long"), ["g"], ["k", "second"]).collect()
    assert Counter((r.g, r.k, r.second) for r in found) == Counter(rows)
    for group in (None, "a", "b"):
        mine = sorted((r for r in found if r.g == group), key=lambda r: r._place)
        assert [r._place for r in mine] == list(range(len(mine))) and {r._total for r in mine} == {len(mine)}
        order = [(r.k is not None, r.k or 0, r.second) for r in mine]
        assert order == sorted(order)


def test_directory_levels_give_the_same_ranks(spark):
    """Keys far apart need directories of several levels, near ones a single level."""
    near = spark.range(0, 20000, 3).select(F.lit("x").alias("g"), F.col("id").alias("k"))
    far = near.withColumn("k", F.col("k") * 4_000_000_000_000)
    for df in (near, far):
        places = bitmaps.places(df, ["g"], ["k"]).orderBy("k").collect()
        assert [r._place for r in places] == list(range(len(places)))


# ---- 11 manifest ----


def _hash(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _way(levels, place):
    way = []
    for hashes in levels[:-1]:
        first = place - place % 3
        way.append((place % 3, hashes[first:place] + hashes[place + 1 : first + 3]))
        place //= 3
    return way


def _manifest(rows):
    def leaf(row, text):
        return _hash(*map(_field, (*row[:4], text)))

    groups, out = defaultdict(list), []
    for row in rows:
        groups[row[1]].append(((row[0] is not None, row[0] or 0, leaf(row, row[4])), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda x: x[0]) for s in names}
    trees = {s: _levels([key[2] for key, _ in ordered[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (key, row) in enumerate(ordered[s]):
            way, text = _way(trees[s], i) + _way(top, k), row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for slot, others in way:
                folded = _hash(*others[:slot], folded, *others[slot:])
            root = top[-1][0]
            out.append((row[0], key[2], trees[s][-1][0], root, _hash("".join("".join(o) for _, o in way)), folded, folded == root))
    return Counter(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _found(df, **options):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    copy = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(df, copy=copy, **options)


def _documents(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string").repartition(3)


def test_manifest_of_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert Counter(tuple(r) for r in _found(df).select(*NAMES).collect()) == _manifest(rows)


def test_manifest_of_odd_rows(spark):
    rng = random.Random(3)
    ids = [None, 1, 2, -5, 2**62, -(2**63), *range(100, 5000, 3)]
    rows = [(rng.choice(ids), rng.choice([None, "a", "a", "a", "ä", "", "b"]), "en", k % 3, rng.choice([None, "", "x\ny", "z\n" * 9000])) for k in range(1500)]
    rows += [(None, "a", None, None, None)] * 600 + [(7, "solo", None, None, "t\n")]
    df = _documents(spark, rows)
    assert Counter(tuple(r) for r in _found(df).select(*NAMES).collect()) == _manifest(rows)
    assert _found(df.where("false")).count() == 0


def test_lone_row_and_proofs(spark):
    rows = [(1, "a", "en", 1, "x\ny")]
    got = _found(_documents(spark, rows)).select(*NAMES).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == _hash("")
    many = _found(spark.read.parquet(f"{SF}/documents.parquet"), with_proof=True).where("verified").collect()
    for r in many[:20]:
        steps = [(s.slot, [bytes(o) for o in s.others]) for s in r.proof]
        assert merkle.fold(bytes.fromhex(r.leaf), steps).hex() == r.root


# ---- 12 resampling ----


def _features(text):
    words = WORD.findall(_low(text))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _resampled(rows, target, percent=25, least=20):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10000

    docs = [(i, *_features(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for x in target for f in _features(x)[1])
    cs, ct, out = sum(s.values()), sum(t.values()), []
    for i, n, fs in docs:
        gains = [math.floor(1000 * math.log((t[bucket(f)] + 1) * (cs + 10000) / ((s[bucket(f)] + 1) * (ct + 10000)))) for f in fs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return Counter(tuple(r) for r in out)


def _odd_texts():
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abcXYZ09é東") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["z" * 300, "q" * 70000]
    texts = [None, "", " \n", "w", *(rng.choice([" ", "-", "\x00", " , "]).join(rng.choice(lexicon) for _ in range(rng.randrange(15, 90))) for _ in range(20))]
    rows = [(rng.choice([None, 1, 2, 3, *range(300)]), rng.choice(texts), "clash") for _ in range(900)]
    return rows + [(None, "one two three " * 9, "clash")] * 400


@pytest.fixture(params=["given", "odd", "none"])
def texts(request, spark):
    if request.param == "given":
        return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("c").alias("score"))
    rows = _odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    return df.where("false") if request.param == "none" else df


def test_resampling(spark, texts):
    target = spark.createDataFrame([("Benchmark words one two",), (None,), ("three words",)], "text string")
    got = resampling.resample(texts, target).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    want = _resampled([(r.doc_id, r.text) for r in texts.collect()], [r.text for r in target.collect()])
    assert Counter(tuple(r) for r in got) == want


def test_resampling_without_targets_and_dictionary(spark, monkeypatch):
    """A dictionary of a single word leaves all others to the gaps between matches, with the same result."""
    monkeypatch.setattr(resampling, "DICTIONARY", 1)
    rows = [(i, t) for i, t, _ in _odd_texts()[:200]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    got = resampling.resample(df, target).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert Counter(tuple(r) for r in got) == _resampled(rows, [])


def test_payload_composition():
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abcdef09\xc3\xa9") for _ in range(rng.choice([1, 2, 3, 9, 80, 5000]))) for _ in range(300)]
    for known in ([], words[:1], words[:150]):
        scanner = resampling.Scanner(known)
        text = b" ".join(words)
        (n, found), (none, nothing) = resampling.buckets_of(scanner, [text, b""])
        want = [zlib.crc32(w) % 10000 for w in words] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(words, words[1:])]
        assert n == len(words) and found.tolist() == want and none == 0 and len(nothing) == 0


# ---- 13 license scan ----

PATTERNS = [re.compile(licenses.spaced(r.pattern)) for r in RULES]
FIGURES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _scanned(text):
    words = WORD.findall(_low(text))
    plain = "".join(f" {w} " for w in words)
    base = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for k, (rule, pattern) in enumerate(zip(RULES, PATTERNS, strict=True)):
        for m in pattern.finditer(plain):
            start = plain[: m.start()].count(" ") // 2
            found.append((start, start + m.group().count(" ") // 2, rule.priority, k, rule.label))

    def beats(e, d):
        wider = e[1] - e[0] > d[1] - d[0]
        return e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or (e[2] == d[2] and (wider or e[3] < d[3])))

    kept = [d for d in found if not any(beats(e, d) for e in found if e is not d)]
    names, starts = {label for _, label in base}, [i for i, _ in base]
    score = max([CONFIDENCE[d[2]] for d in kept] + [CONFIDENCE[1] if base else 0.0])
    figures = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
               ",".join(sorted(names | {d[4] for d in kept})), score)
    return figures, sorted((d[4], d[2], d[0], d[1]) for d in kept)


def _sample(rng, pattern):
    """A text that the pattern matches."""
    while True:
        shorter = re.sub(r"\(\?:([^()]*)\)(\?|\{[^}]*\})?", lambda m: rng.choice(m[1].split("|")) if not (m[2] or "").startswith("?") or rng.random() < 0.5 else "", pattern)
        if shorter == pattern:
            break
        pattern = shorter
    pattern = re.sub(r"\[([a-z])[a-z]*\]", lambda m: m[1], re.sub(r"\[\^ \]\+", "zz", pattern))
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", pattern)


def test_rules_hold_what_their_gates_ask_for():
    rng, gate = random.Random(5), re.compile(licenses.stems(RULES))
    assert len(RULES) > 300 and len(set(RULES)) == len(RULES)
    for rule in RULES:
        for _ in range(5):
            text = _sample(rng, rule.pattern)
            assert re.fullmatch(rule.pattern, text), rule
            assert gate.search(text) and re.search(r"\b(?:" + rule.stem + ")", text), rule
            assert not rule.keyword or rule.keyword in text.split(" "), rule


def _check(df):
    rows = licenses.scan(df).select("row.text", *FIGURES, "spans").collect()
    for r in rows:
        want, spans = _scanned(r.text)
        assert (tuple(r[c] for c in FIGURES), sorted(tuple(s) for s in r.spans)) == (want, spans), r.text
    assert len(rows) == df.count()


def test_license_scan_of_given_documents(spark):
    _check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_license_scan_of_samples(spark):
    rng = random.Random(8)
    texts = [None, "", "Licence", "émit license mit license", "MIT license MIT-License apache license general public license"] * 2
    for rule in RULES:
        more = [_sample(rng, rng.choice(RULES).pattern) for _ in range(2)]
        texts.append(f"foo, {_sample(rng, rule.pattern).title()}; {more[0]} É {more[1].upper()}")
    texts.append("The MIT License. " * 300 + "x" * 3000 + " licensed under the GNU General Public License version 3" * 50)
    df = spark.createDataFrame(list(enumerate(texts)), "labels long, text string").repartition(8)
    _check(df)
    assert licenses.scan(df.where("false")).count() == 0
    specific = licenses.scan(df).where("row.text like 'émit%'").select("n_base", "first_word", "labels").first()
    assert tuple(specific) == (1, 2, "mit")


# ---- 4 mixing: repeated rows without words ----


def test_mix_keeps_every_row_without_words(spark):
    data = [(1, None, "s"), (1, None, "s"), (2, "", "s"), (2, "", "s"), (None, None, "s"), (None, None, "s"), (3, "a b c " * 90, "s"), (3, "a b c " * 90, "s")]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter({(1, 0): 2, (2, 0): 2, (None, 0): 2, (3, 270): 2})
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 2 * r.size for r in got)
