"""Path and name helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_paths(*parts: Column) -> Column:
    """Join by '/', with slashes at both ends of every part removed and empty parts dropped."""
    cleaned = [F.nullif(F.regexp_replace(p, r"^/+|/+\z", ""), F.lit("")) for p in parts]
    return F.concat_ws("/", *cleaned)


def last_part(path: Column, sep: str = ".") -> Column:
    """Text after the last separator; NULL when there is none."""
    return F.when(path.contains(sep), F.substring_index(path, sep, -1))


def id_prefix(key: Column, sep: str, count: int = 1) -> Column:
    return F.substring_index(key, sep, count)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1048576), 2)
