"""Aggregate expressions with the null and tie rules of the readings table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airq.schema import STATUS, STATUS_ORDER


def n_rows() -> Column:
    """Number of rows, nulls included."""
    return F.count(F.lit(1))


def n_status(*statuses: str) -> Column:
    """Number of rows with one of ``statuses``; a null status is never a match."""
    return F.count_if(F.col(STATUS).isin(*statuses))


def counts_by_status() -> list[Column]:
    """One count column per known status, named after it."""
    return [F.expr(f"count_if({STATUS} = '{status}') AS `{status}`") for status in STATUS_ORDER]


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL when there is no whole."""
    return F.try_divide(part, whole)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, NULL when there is no whole."""
    return ratio(part, whole) * 100


def key_of_highest(mean: Column, key: Column) -> Column:
    """Key of the highest mean; the smallest key wins a tie, null means never win.

    ``max_by`` leaves the winner of a tie open, the minimum of a struct does not.
    """
    return F.min(F.when(mean.isNotNull(), F.struct((-mean).alias("m"), key.alias("k"))))["k"]
