"""The near-duplicate stage against all pairs of texts in plain Python."""

import random
import re
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from tallygrove.llm import simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def _set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    """Ids that stay: the smallest of every group that pairs of 0.8 or more connect."""
    sets, group = {i: _set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return sorted(i for i in group if top(i) == i)


def _prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _copy(rng, words, wanted):
    """The words with just so many changed that the similarity to them is the least not under ``wanted``."""
    own, now = _set(" ".join(words)), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        changed = [*now[:at], f"new{at}", *now[at + 1 :]]
        if _similarity(own, _set(" ".join(changed))) < wanted:
            return now
        now = changed
    return now


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def _kept(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, _frame(spark, rows), "").collect())


def test_near_copies_at_every_similarity(spark):
    rng = random.Random(5)
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    planted, start = [], 1 + max(i for i, _ in given)
    for wanted in (0.8, 0.85, 0.9, 0.95):
        for n in (60, 150, 400):
            for _ in range(3):
                words = _prose(rng, n)
                planted += [" ".join(words), " ".join(_copy(rng, words, wanted))]
    rows = given + [(start + k, t) for k, t in enumerate(planted)]
    want = brute_force(rows)
    assert {start + k for k in range(1, len(planted), 2)}.isdisjoint(want)
    assert _kept(spark, rows) == want


def test_texts_under_one_fingerprint(spark):
    # One repeated phrase decides every bit, so that unlike texts share a fingerprint; two of each three are alike.
    rng, rows = random.Random(6), []
    for case in range(8):
        phrase = [f"p{case}"] * 400
        one, other = _prose(rng, 100), _prose(rng, 100)
        texts = [" ".join(phrase + x) for x in (one, other, _copy(rng, other, 0.85))]
        assert len({simhash.fingerprint(t.encode(), 3) for t in texts}) == 1
        rows += [(10 * case + k, t) for k, t in enumerate(texts)]
    want = brute_force(rows)
    assert want == sorted(10 * case + k for case in range(8) for k in (0, 1))
    assert _kept(spark, rows) == want


def test_large_group_and_chains(spark):
    rng = random.Random(7)
    base, rows = _prose(rng, 200), []
    for i in range(150):
        rows.append((i, " ".join(_copy(rng, base, rng.choice((0.8, 0.85, 0.9, 0.97))))))
    link = _prose(rng, 120)
    for i in range(1000, 1012):  # each like the one before, the ends unlike
        rows.append((i, " ".join(link)))
        link = _copy(rng, link, 0.82)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO\n"), (2005, "two one")]
    assert _kept(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("cells", [1, 64])
def test_order_of_shingles_changes_nothing(spark, monkeypatch, cells):
    monkeypatch.setattr(simhash, "ORDER_CELLS", cells)
    rng = random.Random(8)
    base = [_prose(rng, 80) for _ in range(12)]
    line = _prose(rng, 30)
    rows = [(k, " ".join(x + line)) for k, x in enumerate(base + [_copy(rng, x, 0.8) for x in base])]
    assert _kept(spark, rows) == brute_force(rows)


def test_common_passages_are_not_compared_in_pairs(spark, monkeypatch):
    # Unlike texts with one passage, which few of all texts have; listed in pairs they would be 79,800.
    rng = random.Random(9)
    passage = _prose(rng, 40)
    rows = [(k, " ".join(_prose(rng, 90) + (passage if k < 400 else []))) for k in range(2000)]
    compared, plausible = [], simhash._plausible

    def counted(pairs, *more):
        compared.append(pairs.count())
        return plausible(pairs, *more)

    monkeypatch.setattr(simhash, "_plausible", counted)
    assert _kept(spark, rows) == [k for k, _ in rows]
    assert sum(compared) < 4000


def test_very_long_texts(spark):
    rng = random.Random(10)
    long = _prose(rng, 60_000)
    near, far = [*long[:30_000], "other", *long[30_001:]], [*long[:20_000], *_prose(rng, 40_000)]
    rows = [(k, " ".join(x)) for k, x in enumerate((long, near, far))] + [(3, "One two"), (4, None)]
    assert _kept(spark, rows) == brute_force(rows) == [0, 2, 3, 4]


def test_parities_never_pass_over_a_pair():
    rng = random.Random(11)
    for n in (1, 5, 63, 64, 65, 500, 9000):
        words = _prose(rng, n + 4)
        one = simhash.shingle_hashes(" ".join(words).encode(), 5)
        other = simhash.shingle_hashes(" ".join(words[: n // 2] + _prose(rng, max(1, n // 9)) + words[n // 2 :]).encode(), 5)
        p, q = simhash.parities(one), simhash.parities(other)
        while len(p) != len(q):
            p, q = (x if len(x) == min(len(p), len(q)) else x[: len(x) // 2] ^ x[len(x) // 2 :] for x in (p, q))
        assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in p ^ q) <= len(np.setxor1d(one, other))


def test_joined_groups_are_not_linked_again(spark, monkeypatch):
    rng, given, components = random.Random(5), [], simhash.components
    rows = [(i, " ".join(_prose(rng, 60))) for i in range(20)]
    rows += [(20 + i, t + " more") for i, t in rows]
    monkeypatch.setattr(simhash, "components", lambda links, a, b: given.append(links.count()) or components(links, a, b))
    kept = simhash.distinct_texts(_frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_force(rows) == list(range(20))
    assert len(given) == 3 and sum(given) == 20  # each pair is linked once, not in every step after it
