"""Pipe tables against plain Python, and how often a text is taken apart."""

import random
import re

from pyspark.sql import functions as F

from tallygrove.operators import texts as o

_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _table(text):
    lines = [x.strip(_SPACE) for x in text.strip(_SPACE).split("\n")]
    is_row = [("|" in x and not re.fullmatch(f"[{_SPACE}|+-]+", x)) for x in lines]
    if True not in is_row:
        return []
    rows = []
    for x, row in list(zip(lines, is_row, strict=True))[is_row.index(True):]:
        if x == "":
            break
        if row:
            rows.append([c for c in (y.strip(_SPACE) for y in x.split("|")) if c])
    fit = [r for r in rows[1:] if len(r) == len(rows[0])]
    return [(i, j, n, v) for i, r in enumerate(fit) for j, (n, v) in enumerate(zip(rows[0], r, strict=True))]


def test_random_texts(spark):
    draw = random.Random(5)
    parts = ["|", "|", "|", "\n", "\n", "\n", "a", "b", "é", "-", "+", " ", " ", *_SPACE, "\n\n", "| a | b |\n", "|---+---|\n", "\r\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 40))) for _ in range(3000)]
    texts += ["", "|", "||\n|\n", "| a |", "a|b\n\n1|2", "a|b\n1|2\n \t \n3|4", "\u2003 a | b \u2028\nx\u2028y\x85 | z\x85"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").repartition(8)
    found = {}
    for r in o.table_cells(df, "text", ["id"]).collect():
        found.setdefault(r.id, []).append((r.row_no, r.column_no, r.column_name, r.value))
    want = {i: t for i, x in enumerate(texts) if (t := _table(x))}
    assert len(want) > 100 and {i: sorted(t) for i, t in found.items()} == want


def test_long_table(spark):
    text = "note\n" * 20_000 + "a | b\n" + "".join(f"{i} | x \n" for i in range(20_000)) + "\nlate | row"
    df = spark.createDataFrame([(1, text)], "id INT, text STRING")
    cells = o.table_cells(df, "text", ["id"])
    assert (cells.count(), cells.where("column_name = 'b' AND value = 'x'").count()) == (40_000, 20_000)


def test_a_text_is_taken_apart_once(spark, capsys):
    """Two generators, rows and cells; no filter or further column that works out the table again."""
    cells = o.table_cells(spark.range(3).select("id", F.lit("a | b\n1 | 2").alias("text")).where("id > 0"), "text", ["id"])
    cells.explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate") == 2 and plan.count("regexp_extract(") <= 2
