"""Filtered slices: summary, histogram, comparisons, trend and preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airq.functions.frames import highest_first, with_row
from airq.functions.measures import n_rows, percent, ratio
from airq.functions.median import median_of_counts
from airq.operators.overview import mean_by, monthly_mean, status_counts
from airq.schema import (
    DATE,
    GOOD_STATUSES,
    POLLUTANT,
    PREVIEW_COLUMNS,
    STATE,
    STATUS,
    VALUE,
    YEAR,
)


def check_selection(states: Sequence, years: Sequence, pollutants: Sequence) -> None:
    """Raise ``ValueError`` unless each list has at least one entry."""
    for name, chosen in (("state", states), ("year", years), ("pollutant", pollutants)):
        if not len(chosen):
            raise ValueError(f"select at least one {name}")


def filter_readings(
    df: DataFrame, states: Sequence[str], years: Sequence[int], pollutants: Sequence[str]
) -> DataFrame:
    """Readings that match all three lists; nulls never match."""
    check_selection(states, years, pollutants)
    return df.filter(
        F.col(STATE).isin(*states) & F.col(YEAR).isin(*years) & F.col(POLLUTANT).isin(*pollutants)
    )


def is_empty(df: DataFrame) -> bool:
    """Whether a slice has no rows. Runs a job; the operators never call it."""
    return df.isEmpty()


def slice_kpis(df: DataFrame) -> DataFrame:
    """One row: ``readings, mean_aqi, median_aqi, max_aqi, good_pct``.

    All figures come from one count per value, so the slice is scanned and
    shuffled once for the median as well.
    """
    good = F.col(STATUS).isin(*GOOD_STATUSES)
    counts = df.groupBy(VALUE).agg(n_rows().alias("n"), F.count_if(good).alias("good"))
    measured = F.when(F.col(VALUE).isNotNull(), F.col("n")).otherwise(0)
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
        ratio(F.sum(F.col(VALUE) * F.col("n")), F.sum(measured)).alias("mean_aqi"),
        F.max(VALUE).alias("max_aqi"),
        percent(F.sum("good"), F.sum("n")).alias("good_pct"),
    )
    # The condition looks at both counts so that it stays above the aggregation, and
    # the median reuses its shuffle (see ``drop_null_key``).
    present = F.when((F.col("n") >= 0) & (F.col("good") >= 0), F.col(VALUE)).isNotNull()
    median = median_of_counts(counts.filter(present), VALUE, "n", name="median_aqi")
    return with_row(median, totals).select(
        "readings", "mean_aqi", "median_aqi", "max_aqi", "good_pct"
    )


def value_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """``bin 1..bins, lo, hi, readings`` of equal-width bins from min to max.

    A bin holds ``lo <= value < hi``, the last one also its upper edge; empty
    bins are present. Equal values widen the range by a half on both sides. A
    slice without values has no bins. The bin guessed by division is checked
    against the published edges, so rounding never puts a value next door.
    """
    counts = df.groupBy(VALUE).agg(F.count(VALUE).alias("readings")).filter("readings > 0")
    span = counts.agg(F.min(VALUE).alias("low"), F.max(VALUE).alias("high"))
    spread = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    ranged = with_row(counts, span).select(
        VALUE, "readings",
        (F.col("low") - spread).alias("low"), (F.col("high") + spread).alias("high"),
    )

    width = (F.col("high") - F.col("low")) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("high")).otherwise(F.col("low") + i * width)

    value = F.col(VALUE)
    guess = F.least(
        F.floor((value - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)
    )
    slot = (
        F.when(value < edge(F.col("guess")), F.col("guess") - 1)
        .when(
            (value >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1), F.col("guess") + 1
        )
        .otherwise(F.col("guess"))
    )
    placed = ranged.withColumn("guess", guess).withColumn("slot", slot)
    filled = placed.groupBy("low", "high", "slot").agg(F.sum("readings").alias("readings"))
    # One row holding at most `bins` counts.
    whole = filled.groupBy("low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "readings"))).alias("tally")
    )
    i = F.col("i")
    return whole.select(
        "low", "high", "tally", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("i")
    ).select(
        (i + 1).alias("bin"),
        edge(i).alias("lo"),
        edge(i + 1).alias("hi"),
        F.coalesce(F.try_element_at("tally", i.cast("bigint")), F.lit(0)).alias("readings"),
    )


def filtered_kpis(
    df: DataFrame, states: Sequence[str], years: Sequence[int], pollutants: Sequence[str]
) -> DataFrame:
    """``slice_kpis`` of a selection."""
    return slice_kpis(filter_readings(df, states, years, pollutants))


def filtered_histogram(
    df: DataFrame,
    states: Sequence[str],
    years: Sequence[int],
    pollutants: Sequence[str],
    bins: int = 40,
) -> DataFrame:
    """``value_histogram`` of a selection."""
    return value_histogram(filter_readings(df, states, years, pollutants), bins)


def filtered_status_counts(
    df: DataFrame, states: Sequence[str], years: Sequence[int], pollutants: Sequence[str]
) -> DataFrame:
    """``status_counts`` of a selection."""
    return status_counts(filter_readings(df, states, years, pollutants))


def state_comparison(
    df: DataFrame, states: Sequence[str], years: Sequence[int], pollutants: Sequence[str]
) -> DataFrame:
    """``state, mean_aqi`` of a selection, highest first; no rows for a single state."""
    chosen = filter_readings(df, states, years, pollutants)
    if len(set(states)) < 2:
        chosen = chosen.filter(F.lit(False))
    return mean_by(chosen, STATE).orderBy(*highest_first("mean_aqi", STATE))


def filtered_monthly_mean(
    df: DataFrame, states: Sequence[str], years: Sequence[int], pollutants: Sequence[str]
) -> DataFrame:
    """``monthly_mean`` of a selection."""
    return monthly_mean(filter_readings(df, states, years, pollutants))


def preview_rows(df: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` rows, seven columns.

    Readings have no key, so every other column breaks ties on the date. Counts
    per day, which need the date alone, give the earliest day that can still be
    among the newest ``n`` rows. Only days from there on are read in full and go
    into the top-n; the comparison prunes the folders of older years and reaches
    parquet. Rows without a date come last and always stay candidates.
    """
    per_day = df.filter(F.col(DATE).isNotNull()).groupBy(DATE).agg(n_rows().alias("readings"))
    # No partition: one row per calendar day.
    seen = F.sum("readings").over(
        Window.orderBy(F.col(DATE).desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    first_day = per_day.withColumn("seen", seen).agg(
        F.coalesce(F.max(F.when(F.col("seen") >= n, F.col(DATE))), F.min(DATE))
    )
    dated, undated = F.col(DATE) >= first_day.scalar(), F.col(DATE).isNull()
    if YEAR in df.columns:  # the stored table has a folder per year
        dated = (F.col(YEAR) >= F.year(first_day.scalar())) & dated
        undated = F.col(YEAR).isNull() & undated
    candidates = df.filter(dated).select(*PREVIEW_COLUMNS).unionAll(
        df.filter(undated).select(*PREVIEW_COLUMNS)
    )
    ties = [F.col(c).asc_nulls_last() for c in PREVIEW_COLUMNS if c != DATE]
    return candidates.orderBy(F.col(DATE).desc_nulls_last(), *ties).limit(n)


def preview_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows of a slice."""
    return df.agg(n_rows().alias("readings"))
