"""Headline figures, status shares, monthly trend and key findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.functions.frames import highest_first, lowest_first, status_counts_rows
from airq.functions.measures import counts_by_status, n_rows, n_status, percent, ratio
from airq.schema import (
    AREA,
    DATE,
    DEFAULT_POLLUTANTS,
    GOOD_STATUSES,
    POLLUTANT,
    STATE,
    STATUS_ORDER,
    VALUE,
    WORST_STATUS,
)


def national_kpis(df: DataFrame) -> DataFrame:
    """One row: ``readings, states, areas, mean_aqi, good_pct``.

    Combined per (state, area) first, see ``dataset_profile``. ``good_pct`` is a
    share of all rows: a missing status counts as not good.
    """
    per_area = df.groupBy(STATE, AREA).agg(
        n_rows().alias("n"),
        F.sum(VALUE).alias("total"),
        F.count(VALUE).alias("measured"),
        n_status(*GOOD_STATUSES).alias("good"),
    )
    return per_area.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
        F.count_distinct(STATE).alias("states"),
        F.count_distinct(AREA).alias("areas"),
        ratio(F.sum("total"), F.sum("measured")).alias("mean_aqi"),
        percent(F.sum("good"), F.sum("n")).alias("good_pct"),
    )


def status_tally(df: DataFrame) -> DataFrame:
    """``total, status, status_ord, readings``: all six statuses in domain order.

    One pass and one row through the shuffle; ``total`` counts every row of
    ``df``, also those whose status is missing or unknown.
    """
    wide = df.agg(n_rows().alias("total"), *counts_by_status())
    return status_counts_rows(wide, ["total"])


def status_counts(df: DataFrame) -> DataFrame:
    """``status, status_ord, readings`` of the statuses that occur."""
    return status_tally(df).filter("readings > 0").drop("total")


def status_share_table(df: DataFrame) -> DataFrame:
    """All six statuses with ``readings`` and ``pct`` of all rows."""
    return status_tally(df).select(
        "status", "status_ord", "readings",
        percent(F.col("readings"), F.col("total")).alias("pct"),
    )


def status_pie_share(df: DataFrame) -> DataFrame:
    """Statuses that occur with ``pct`` of the rows whose status is known."""
    wide = df.agg(*counts_by_status())
    known = " + ".join(f"`{status}`" for status in STATUS_ORDER)
    rows = status_counts_rows(wide, [f"{known} AS known"])
    return rows.filter("readings > 0").select(
        "status", "status_ord", percent(F.col("readings"), F.col("known")).alias("pct")
    )


def monthly_mean(df: DataFrame) -> DataFrame:
    """``month_start, mean_aqi`` per calendar month, in order."""
    return (
        df.filter(F.col(DATE).isNotNull())
        .groupBy(F.trunc(DATE, "MM").alias("month_start"))
        .agg(F.avg(VALUE).alias("mean_aqi"))
        .orderBy("month_start")
    )


def mean_by(df: DataFrame, key: str) -> DataFrame:
    """``key, mean_aqi``; rows without a key do not form a group."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(VALUE).alias("mean_aqi"))


def _first_measured(df: DataFrame, key: str, order) -> DataFrame:
    means = mean_by(df, key).filter(F.col("mean_aqi").isNotNull())
    return means.orderBy(*order("mean_aqi", key)).limit(1)


def worst_state(df: DataFrame) -> DataFrame:
    """``state, mean_aqi`` of the highest mean; ties go to the smaller name."""
    return _first_measured(df, STATE, highest_first)


def best_state(df: DataFrame) -> DataFrame:
    """``state, mean_aqi`` of the lowest mean; ties go to the smaller name."""
    return _first_measured(df, STATE, lowest_first)


def worst_area(df: DataFrame) -> DataFrame:
    """``area, mean_aqi`` of the highest mean, however few readings it has."""
    return _first_measured(df, AREA, highest_first)


def severe_share(df: DataFrame) -> DataFrame:
    """One row: ``pct`` of all rows that have the worst status."""
    return df.agg(percent(n_status(WORST_STATUS), n_rows()).alias("pct"))


def pollutant_share(df: DataFrame, name: str = DEFAULT_POLLUTANTS[0]) -> DataFrame:
    """One row: ``pct`` of all rows whose primary pollutant is ``name``."""
    hits = F.count_if(F.col(POLLUTANT) == name)
    return df.agg(percent(hits, n_rows()).alias("pct"))
