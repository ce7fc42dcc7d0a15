"""Text helpers: fenced SQL blocks, pipe tables, error clean-up, message parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CELL_EDGE, CSV_AFTER, ERROR_CODE, ERROR_LENGTH, ERROR_TAIL, FROM_FIRST_ROW, PLAIN_BLOCK, RULE_LINE, SPACE, SQL_BLOCK, SQL_WORDS,
)
from .once import named


def strip(text: Column) -> Column:
    """Remove white space, line ends included, from both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def sql_block(text: Column) -> Column:
    """First block marked as SQL, else the first plain block when it holds an SQL word, else NULL."""
    plain = strip(F.regexp_extract(text, PLAIN_BLOCK, 1))
    return F.when(text.rlike(SQL_BLOCK), strip(F.regexp_extract(text, SQL_BLOCK, 1))).when(
        text.rlike(PLAIN_BLOCK) & F.upper(plain).rlike("|".join(SQL_WORDS)), plain
    )


def marked_sql(text: Column) -> Column:
    """Only a block marked as SQL; an empty string when there is none."""
    return F.coalesce(F.when(text.rlike(SQL_BLOCK), strip(F.regexp_extract(text, SQL_BLOCK, 1))), F.lit(""))


def clean_error(text: Column, length: int = ERROR_LENGTH) -> Column:
    """Drop the first three-digit code, cut long texts, strip."""
    bare = F.regexp_replace(text, ERROR_CODE, "$1")
    cut = F.when(
        F.length(bare) > length, F.concat(F.substring(bare, 1, length), F.lit(ERROR_TAIL))
    ).otherwise(bare)
    return strip(cut)


def join_parts(parts: Column) -> Column:
    """Texts of a message's parts, one per line; a part without text counts as its JSON form."""
    return F.coalesce(
        F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.to_json(p))), "\n"), F.lit("")
    )


def cut_cell(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def is_pipe_row(line: Column) -> Column:
    """Whether a stripped line is a row of a pipe table and not a rule."""
    return line.contains("|") & ~line.rlike(RULE_LINE)


def pipe_table(text: Column) -> Column:
    """Cells of the first pipe table, header first: from its first row to the next blank line, rows as wide as the header.

    Space around lines and cells goes in one pass over the text; what is not part of the table is never split.
    """
    rest = F.regexp_extract(F.regexp_replace(strip(text), CELL_EDGE, "$1"), FROM_FIRST_ROW, 0)
    lines = F.filter(F.split(F.substring_index(rest, "\n\n", 1), "\n"), is_pipe_row)
    rows = F.transform(lines, lambda x: F.filter(F.split(x, "\\|"), lambda c: c != ""))
    return named(rows, lambda t: F.filter(t, lambda r: F.size(r) == F.size(F.get(t, F.lit(0)))))


def csv_after_marker(text: Column) -> Column:
    """Text behind the row-count line of a tool answer, where its CSV starts; NULL when there is none."""
    return F.when(text.rlike(CSV_AFTER), strip(F.regexp_extract(text, CSV_AFTER, 1)))


_RECORD, _FIELD = "\u001e", "\u001f"


def csv_records(text: Column) -> Column:
    """CSV records; line ends and commas count only outside quotes, in every second piece between quote marks."""
    pieces = F.transform(
        F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), '"'),
        lambda piece, i: F.when(i % 2 == 0, F.translate(piece, "\n,", _RECORD + _FIELD)).otherwise(piece),
    )
    return F.filter(F.split(F.array_join(pieces, '"'), _RECORD), lambda line: strip(line) != "")


def csv_cells(record: Column) -> Column:
    """Fields of one record, unquoted."""
    return F.transform(
        F.split(record, _FIELD),
        lambda cell: F.when(
            cell.rlike(r'(?s)^".*"\z'),
            F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(cell),
    )


def csv_table(text: Column) -> Column:
    """Fields of the CSV behind the row-count line, header first; NULL where a record is longer than the header."""
    records = F.transform(csv_records(csv_after_marker(text)), csv_cells)
    return named(records, lambda t: F.when(F.forall(t, lambda r: F.size(r) <= F.size(F.get(t, F.lit(0)))), t))
