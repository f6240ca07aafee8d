"""Expressions that turn one text cell into one typed value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from airq.schema import (
    DATE_FORMATS,
    MONTH_LABELS,
    NULL_TOKENS,
    SEASON_MONTHS,
    STATUS_ORDER,
    STATUS_UPPER_LIMITS,
    WHITESPACE,
)

# Plain decimal notation. A bare cast would also take Java forms such as '12d'.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE_PATTERN = r"^[+-]?\d+(\.0*)?$"


def null_if_missing(cell: Column) -> Column:
    """The cell, or NULL when it is one of the missing-value tokens."""
    return F.when(~cell.isin(*NULL_TOKENS), cell)


def _visible_ascii(char: Column) -> Column:
    return F.ascii(char).between(33, 126)


def strip(cell: Column) -> Column:
    """Remove Unicode whitespace at both ends.

    ``trim`` takes blanks only but is nearly free. ``btrim`` with a character set
    takes about a microsecond per cell, so only cells that still begin or end
    with something other than a visible ASCII character go through it.
    """
    trimmed = F.trim(cell)
    done = _visible_ascii(trimmed) & _visible_ascii(F.substring(trimmed, -1, 1))
    return F.when(done, trimmed).otherwise(F.btrim(trimmed, F.lit(WHITESPACE)))


def parse_day_first(cell: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date from day-first text, NULL when no format fits."""
    return F.coalesce(*[F.try_to_date(cell, f) for f in formats])


def to_number(cell: Column) -> Column:
    """DOUBLE from decimal text, NULL for anything else and for what overflows."""
    number = cell.try_cast("double")
    return F.when(cell.rlike(NUMBER_PATTERN) & (F.abs(number) < float("inf")), number)


def to_count(cell: Column) -> Column:
    """INT from decimal text without a fraction, NULL for anything else."""
    whole = F.substring_index(cell, ".", 1)
    zero_fraction = F.when(cell.rlike(WHOLE_PATTERN), whole.try_cast("int"))
    return F.coalesce(cell.try_cast("int"), zero_fraction)


def season_of(month: Column) -> Column:
    """Season label of a month number."""
    label = F.lit(None).cast("string")
    for season, months in SEASON_MONTHS.items():
        label = F.when(month.isin(*months), season).otherwise(label)
    return label


def first_listed(cell: Column) -> Column:
    """First element of a comma-separated list, stripped."""
    return strip(F.substring_index(cell, ",", 1))


def aqi_band(value: Column) -> Column:
    """Status whose value band holds ``value``; above the last limit: the worst."""
    band = F.when(value > STATUS_UPPER_LIMITS[-1], STATUS_ORDER[-1])
    for limit, status in zip(reversed(STATUS_UPPER_LIMITS), reversed(STATUS_ORDER[:-1])):
        band = F.when(value <= limit, status).otherwise(band)
    return band


def month_label(month: Column) -> Column:
    """Short English label of a month number."""
    return F.get(F.array(*[F.lit(label) for label in MONTH_LABELS]), month - 1)
