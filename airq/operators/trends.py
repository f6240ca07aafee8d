"""Year, month and season trends, status mix over time, annual summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airq.functions.cells import month_label
from airq.functions.frames import highest_first, shares_of, spine, stack_of
from airq.functions.measures import (
    counts_by_status,
    key_of_highest,
    n_rows,
    n_status,
    percent,
    ratio,
)
from airq.functions.median import median_of_counts
from airq.operators.overview import mean_by
from airq.schema import (
    COMPARED_YEARS,
    DATE,
    GOOD_STATUSES,
    MONTH,
    MONTH_LABELS,
    POOR_STATUSES,
    SEASON,
    STATUS,
    VALUE,
    YEAR,
)

MONTH_START = "month_start"


def year_month_mean(df: DataFrame, years: Sequence[int] = COMPARED_YEARS) -> DataFrame:
    """``year, month, mean_aqi`` of the given years, in order."""
    return (
        df.filter(F.col(YEAR).isin(*years))
        .groupBy(YEAR, MONTH)
        .agg(F.avg(VALUE).alias("mean_aqi"))
        .orderBy(YEAR, MONTH)
    )


def season_mean(df: DataFrame) -> DataFrame:
    """``season, mean_aqi``, highest first."""
    return mean_by(df, SEASON).orderBy(*highest_first("mean_aqi", SEASON))


def season_status_share(df: DataFrame) -> DataFrame:
    """``season, status, readings, pct``; pct of all rows of the season.

    Rows without a status stay in the total and leave afterwards. The window
    runs over at most a handful of counted rows per season.
    """
    counts = (
        df.filter(F.col(SEASON).isNotNull())
        .groupBy(SEASON, F.col(STATUS).alias("status"))
        .agg(n_rows().alias("readings"))
    )
    total = F.sum("readings").over(Window.partitionBy(SEASON))
    return (
        counts.withColumn("pct", percent(F.col("readings"), total))
        .filter(F.col("status").isNotNull())
        .orderBy(SEASON, "status")
    )


def _status_shares(df: DataFrame, key: str, total: Column) -> DataFrame:
    """``key`` and six percentages; keys that only have null statuses are left out."""
    wide = df.groupBy(key).agg(
        total.alias("total"), F.count(STATUS).alias("labelled"), *counts_by_status()
    )
    return shares_of(wide.filter("labelled > 0"), [key], "total")


def _season_shares(df: DataFrame) -> DataFrame:
    return _status_shares(df.filter(F.col(SEASON).isNotNull()), SEASON, n_rows())


def season_status_wide(df: DataFrame) -> DataFrame:
    """``season`` and one percentage column per known status, absent = 0."""
    return _season_shares(df).orderBy(SEASON)


def season_status_stack(df: DataFrame) -> DataFrame:
    """``season, status, status_ord, lower, upper`` of the stacked percentages."""
    return stack_of(_season_shares(df), [SEASON]).orderBy(SEASON, "status_ord")


def year_month_matrix(df: DataFrame, years: Sequence[int] = COMPARED_YEARS) -> DataFrame:
    """``year, Jan … Dec``: mean per month, NULL where there is none."""
    wide = (
        df.filter(F.col(YEAR).isin(*years))
        .groupBy(YEAR)
        .pivot(MONTH, list(range(1, 13)))
        .agg(F.avg(VALUE))
    )
    return wide.toDF(YEAR, *MONTH_LABELS).orderBy(YEAR)


def _labelled_months(df: DataFrame) -> DataFrame:
    return df.filter(F.col(DATE).isNotNull() & F.col(STATUS).isNotNull()).withColumn(
        MONTH_START, F.trunc(DATE, "MM")
    )


def month_status_share(df: DataFrame) -> DataFrame:
    """``month_start, status, readings, pct``; pct of the rows with a status."""
    counts = (
        _labelled_months(df)
        .groupBy(MONTH_START, F.col(STATUS).alias("status"))
        .agg(n_rows().alias("readings"))
    )
    total = F.sum("readings").over(Window.partitionBy(MONTH_START))
    return counts.withColumn("pct", percent(F.col("readings"), total)).orderBy(
        MONTH_START, "status"
    )


def _month_shares(df: DataFrame) -> DataFrame:
    return _status_shares(_labelled_months(df), MONTH_START, n_rows())


def month_status_wide(df: DataFrame) -> DataFrame:
    """``month_start`` and one percentage column per known status, absent = 0."""
    return _month_shares(df).orderBy(MONTH_START)


def month_status_stack(df: DataFrame) -> DataFrame:
    """``month_start, status, status_ord, lower, upper`` of the stacked percentages."""
    return stack_of(_month_shares(df), [MONTH_START]).orderBy(MONTH_START, "status_ord")


def annual_summary(df: DataFrame, years: Sequence[int] = COMPARED_YEARS) -> DataFrame:
    """One row per requested year, in the order requested.

    ``year, readings, mean_aqi, median_aqi, good_pct, poor_pct, worst_month``
    (month number). A year without rows has 0 readings and NULLs.
    """
    rows = df.filter(F.col(YEAR).isin(*years))
    by_month = rows.groupBy(YEAR, MONTH).agg(
        n_rows().alias("n"),
        F.sum(VALUE).alias("total"),
        F.count(VALUE).alias("measured"),
        n_status(*GOOD_STATUSES).alias("good"),
        n_status(*POOR_STATUSES).alias("poor"),
    )
    by_year = by_month.groupBy(YEAR).agg(
        F.sum("n").alias("n"),
        ratio(F.sum("total"), F.sum("measured")).alias("mean_aqi"),
        percent(F.sum("good"), F.sum("n")).alias("good_pct"),
        percent(F.sum("poor"), F.sum("n")).alias("poor_pct"),
        key_of_highest(ratio(F.col("total"), F.col("measured")), F.col(MONTH)).alias("worst_month"),
    )
    counts = rows.groupBy(YEAR, VALUE).agg(F.count(VALUE).alias("measured"))
    medians = median_of_counts(
        counts.filter("measured > 0"), VALUE, "measured", [YEAR], "median_aqi"
    )
    return (
        spine(df.sparkSession, YEAR, years)
        .join(by_year, YEAR, "left")
        .join(F.broadcast(medians), YEAR, "left")  # a row per requested year
        .orderBy("position")
        .select(
            YEAR,
            F.coalesce("n", F.lit(0)).alias("readings"),
            "mean_aqi", "median_aqi", "good_pct", "poor_pct", "worst_month",
        )
    )


def _decimal_text(value: str) -> Column:
    """One decimal, no thousands separator."""
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit(""))


def annual_summary_text(df: DataFrame, years: Sequence[int] = COMPARED_YEARS) -> DataFrame:
    """``annual_summary`` as display text."""
    return annual_summary(df, years).select(
        YEAR,
        F.format_number("readings", 0).alias("readings"),
        _decimal_text("mean_aqi").alias("mean_aqi"),
        _decimal_text("median_aqi").alias("median_aqi"),
        F.concat(_decimal_text("good_pct"), F.lit("%")).alias("good_pct"),
        F.concat(_decimal_text("poor_pct"), F.lit("%")).alias("poor_pct"),
        month_label(F.col("worst_month")).alias("worst_month"),
    )
