"""State and area rankings, drill-down into one state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airq.functions.cells import month_label
from airq.functions.frames import (
    drop_null_key,
    highest_first,
    lowest_first,
    spine,
    with_row,
)
from airq.functions.measures import key_of_highest, n_rows, percent, ratio
from airq.operators.overview import mean_by, status_tally
from airq.schema import AREA, DEFAULT_STATES, MONTH, STATE, VALUE

MIN_READINGS = 50


def state_ranking(df: DataFrame) -> DataFrame:
    """``state, mean_aqi, national_mean``, highest first.

    The national mean is over all readings, also those without a state. It is
    summed up from the per-state sums, so the readings are scanned once.
    """
    per_state = df.groupBy(STATE).agg(
        F.sum(VALUE).alias("total"), F.count(VALUE).alias("measured")
    )
    national = per_state.agg(
        ratio(F.sum("total"), F.sum("measured")).alias("national_mean")
    )
    return (
        with_row(drop_null_key(per_state, STATE, "measured"), national)
        .select(
            STATE, ratio(F.col("total"), F.col("measured")).alias("mean_aqi"), "national_mean"
        )
        .orderBy(*highest_first("mean_aqi", STATE))
    )


def area_ranking(df: DataFrame, min_readings: int = MIN_READINGS) -> DataFrame:
    """``area, mean_aqi, readings, state`` of areas with enough values, highest first.

    Areas are grouped by name alone, so equal names in two states merge and the
    smaller state name is shown.
    """
    return _areas(df, min_readings).orderBy(*highest_first("mean_aqi", AREA))


def _areas(df: DataFrame, min_readings: int) -> DataFrame:
    """Unsorted ``area_ranking``.

    The minimum of a text cannot be kept in a hash aggregation, Spark would sort
    the readings for it. So they are combined per (area, state) first.
    """
    per_pair = df.filter(F.col(AREA).isNotNull()).groupBy(AREA, STATE).agg(
        F.sum(VALUE).alias("total"), F.count(VALUE).alias("measured")
    )
    return (
        per_pair.groupBy(AREA)
        .agg(
            ratio(F.sum("total"), F.sum("measured")).alias("mean_aqi"),
            F.sum("measured").alias("readings"),
            F.min(STATE).alias("state"),
        )
        .filter(F.col("readings") >= min_readings)
    )


def top_areas(df: DataFrame, n: int = 10, min_readings: int = MIN_READINGS) -> DataFrame:
    """The first ``n`` of ``area_ranking``."""
    return area_ranking(df, min_readings).limit(n)


def bottom_areas(df: DataFrame, n: int = 10, min_readings: int = MIN_READINGS) -> DataFrame:
    """The last ``n`` of ``area_ranking``, lowest mean first."""
    last = _areas(df, min_readings).orderBy(
        F.col("mean_aqi").asc_nulls_first(), F.col(AREA).desc_nulls_first()
    )
    return last.limit(n).orderBy(*lowest_first("mean_aqi", AREA))


def state_slice(df: DataFrame, state: str = DEFAULT_STATES[0]) -> DataFrame:
    """The readings of one state."""
    return df.filter(F.col(STATE) == state)


def state_cards(df: DataFrame, state: str = DEFAULT_STATES[0]) -> DataFrame:
    """One row: ``mean_aqi, readings, areas, worst_month`` (label) of a state.

    The readings are scanned once; the window adds the mean of the month to the
    summed-up (area, month) rows.
    """
    per_cell = state_slice(df, state).groupBy(AREA, MONTH).agg(
        n_rows().alias("n"), F.sum(VALUE).alias("total"), F.count(VALUE).alias("measured")
    )
    month = Window.partitionBy(MONTH)
    month_mean = ratio(F.sum("total").over(month), F.sum("measured").over(month))
    return (
        per_cell.withColumn("month_mean", F.when(F.col(MONTH).isNotNull(), month_mean))
        .agg(
            ratio(F.sum("total"), F.sum("measured")).alias("mean_aqi"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
            F.count_distinct(AREA).alias("areas"),
            key_of_highest(F.col("month_mean"), F.col(MONTH)).alias("worst"),
        )
        .select(
            "mean_aqi", "readings", "areas", month_label(F.col("worst")).alias("worst_month")
        )
    )


def state_month_profile(df: DataFrame, state: str = DEFAULT_STATES[0]) -> DataFrame:
    """``month 1..12, label, mean_aqi`` across years, gaps as NULL."""
    months = spine(df.sparkSession, MONTH, range(1, 13))
    return (
        months.join(mean_by(state_slice(df, state), MONTH), MONTH, "left")
        .orderBy(MONTH)
        .select(MONTH, month_label(F.col(MONTH)).alias("label"), "mean_aqi")
    )


def state_area_ranking(df: DataFrame, state: str = DEFAULT_STATES[0], n: int = 10) -> DataFrame:
    """``area, mean_aqi``: the ``n`` highest areas of a state."""
    means = mean_by(state_slice(df, state), AREA)
    return means.orderBy(*highest_first("mean_aqi", AREA)).limit(n)


def state_status_breakdown(df: DataFrame, state: str = DEFAULT_STATES[0]) -> DataFrame:
    """Statuses that occur in a state, ``pct`` of all its rows."""
    return (
        status_tally(state_slice(df, state))
        .filter("readings > 0")
        .select(
            "status", "status_ord", "readings",
            percent(F.col("readings"), F.col("total")).alias("pct"),
        )
    )
