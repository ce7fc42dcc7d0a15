"""Ages and age bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AGE_EDGES, AGE_LABELS, DAYS_PER_YEAR

_SECONDS_PER_DAY = 86400


def _wall_micros(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp"))


def age_by_days(event: Column, birth: Column) -> Column:
    """Whole 24-hour spans between birth and event, divided by the mean year and rounded down."""
    days = F.floor((_wall_micros(event) - _wall_micros(birth)) / F.lit(_SECONDS_PER_DAY * 1_000_000))
    return F.floor(days / F.lit(DAYS_PER_YEAR)).cast("long")


def age_by_calendar(event: Column, birth: Column) -> Column:
    """Completed calendar years; 29 February completes a year on 1 March.

    The year difference loses one when month, day and time of day have not come round yet, which
    stays right where ``months_between`` treats two month ends as a whole month. Dates before birth
    round toward zero, as whole-year periods do.
    """
    def position(when: Column) -> Column:
        ts = when.cast("timestamp")
        day_micros = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
        return F.struct(F.month(ts), F.dayofmonth(ts), day_micros)

    years = F.year(event) - F.year(birth)
    forward = years - F.when(position(event) < position(birth), 1).otherwise(0)
    backward = years + F.when(position(event) > position(birth), 1).otherwise(0)
    value = F.when(event.cast("timestamp") >= birth.cast("timestamp"), forward).otherwise(backward)
    return F.when(event.isNotNull() & birth.isNotNull(), value).cast("long")


def age_today(birth: Column, as_of: Column | None = None) -> Column:
    """Difference of the calendar years, at ``as_of`` or today."""
    return (F.year(as_of if as_of is not None else F.current_date()) - F.year(birth)).cast("long")


def age_band(age: Column) -> Column:
    """Four reporting bands; a missing age stays missing."""
    chain = None
    for edge, label in zip(AGE_EDGES, AGE_LABELS):
        chain = F.when(age <= edge, label) if chain is None else chain.when(age <= edge, label)
    return chain.when(age.isNotNull(), AGE_LABELS[-1])


def width_band(age: Column, width: int, least: int | None) -> Column:
    """Bands of equal width, closed on the right, edges at multiples of the width.

    The first band starts at or below ``least``, the smallest age of all, and is closed on both sides.
    """
    start = (least or 0) // width * width
    top = F.lit(start) + (F.greatest(F.ceil((age - F.lit(start)) / F.lit(width)), F.lit(1)) * width).cast("long")
    low = top - width
    opening = F.when(low == start, "[").otherwise("(")
    return F.when(age.isNotNull(), F.concat(opening, low.cast("string"), F.lit(","), top.cast("string"), F.lit("]")))
