"""No hidden figure follows from shown ones: linear algebra over all totals of random tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import counts as n

LIMIT = 5


def _derivable(nodes, parts):
    """Hidden nodes whose figure the equations total = sum of parts settle; ``nodes`` maps a node to whether it is hidden."""
    gone = [v for v, hidden in nodes.items() if hidden]
    place = {v: i for i, v in enumerate(gone)}
    m = np.zeros((len(parts) + 1, len(gone)))
    for row, (total, below) in enumerate(parts.items()):
        for v, sign in [(total, -1), *((b, 1) for b in below)]:
            if v in place:
                m[row, place[v]] = sign
    rank = np.linalg.matrix_rank(m) if gone else 0
    units = np.eye(len(gone))
    return [v for v in gone if np.linalg.matrix_rank(np.vstack([m, units[place[v]]])) == rank]


def _tables():
    rng = random.Random(7)
    for round_ in range(12):
        rows, person = [], 0
        for a in [None, "x", "y", "z"][: rng.randrange(1, 5)]:
            for b in ["p", "q", None][: rng.randrange(1, 4)]:
                for c in range(rng.randrange(1, 4)):
                    for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 14])):
                        rows.append((a, b, c, person))
                        person += 1
        yield round_, rows


SETS = [["a", "b", "c"], ["a", "b"], ["a"], []]


@pytest.mark.parametrize("depth", [2, 4])
def test_no_hidden_figure_follows(spark, depth):
    data = [(str(t), *r) for t, rows in _tables() for r in rows]
    df = spark.createDataFrame(data, "t STRING, a STRING, b STRING, c INT, person_id INT")
    sets = [["t", *s] for s in SETS[:depth]]
    shown = n.hide_small_cells(df, sets[0], {"n_rows": F.count(F.lit(1))}, limit=LIMIT, also=sets[1:]).collect()
    plain = n.hide_small_cells(df, sets[0], {"n_rows": F.count(F.lit(1))}, limit=LIMIT, also=sets[1:], complement=False).collect()
    assert len(shown) == len(plain)
    before = {tuple(r[k] for k in sets[0]) + (len(r.grouped_by),): r.suppressed for r in plain}
    more = 0
    for t, rows in _tables():
        nodes, parts, size = {}, {}, {}
        for r in (r for r in shown if r.t == str(t)):
            node = (len(r.grouped_by) - 1, tuple(r[k] for k in SETS[0])[: len(r.grouped_by) - 1])
            people = {p for *key, p in rows if tuple(key)[: node[0]] == node[1]}
            nodes[node], size[node] = r.suppressed, len(people)
            assert r.n_persons == (None if r.suppressed else len(people)) and (r.n_rows is None) == r.suppressed
            was = before[tuple(r[k] for k in sets[0]) + (len(r.grouped_by),)]
            assert r.suppressed or not was and len(people) >= LIMIT
            more += r.suppressed and not was
        for level, key in nodes:
            below = [v for v in nodes if v[0] == level + 1 and v[1][:level] == key]
            if below:
                parts[level, key] = below
        assert _derivable(nodes, parts) == []
        for total, below in parts.items():
            together = [size[v] for v in below if nodes[v]]
            assert nodes[total] or not together or sum(together) >= LIMIT
    assert more > 0


def test_totals_must_be_nested(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a INT, b INT, person_id INT")
    with pytest.raises(ValueError, match="nested"):
        n.hide_small_cells(df, ["a", "b"], {}, also=[["a"], ["b"]])
    assert n.hide_small_cells(df, ["a", "b"], {}, also=[["a"], ["b"]], complement=False).count() == 3
    assert n.hide_small_cells(df.where("false"), ["a", "b"], {}, also=[["a"]]).count() == 0


def test_smallest_part_is_hidden_beside_a_single_one(spark, rows):
    people = [("a", "s", i) for i in range(3)] + [("a", "m", 100 + i) for i in range(8)] + [("a", "l", 200 + i) for i in range(30)]
    people += [("lone", "s", 300 + i) for i in range(9)] + [("lone", "t", 400)]
    df = spark.createDataFrame(people, "g STRING, kind STRING, person_id INT")
    got = n.hide_small_cells(df, ["g", "kind"], {}, limit=LIMIT, also=[["g"]])
    assert rows(got.where("grouped_by = array('g', 'kind')"), "g", "kind", "n_persons") == [("a", "l", 30), ("a", "m", None), ("a", "s", None), ("lone", "s", None), ("lone", "t", None)]
    assert rows(got.where("grouped_by = array('g')"), "g", "n_persons") == [("a", 41), ("lone", 10)]
