"""One entry per operator, applied to the readings derived from the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airq.functions.cells import aqi_band
from airq.functions.measures import n_rows
from airq.operators import catalog, explore, overview, pollutants, regions, sites, summary, trends
from airq.schema import VALUE
from airq.sources import clustered, footers, rejects, store, tables

# Values of the test tables that stand in for the default parameters (FIXTURES.md).
YEARS = (1996, 1997, 1998)
STATE = "NATION_0"
STATES = ("NATION_0", "NATION_1")
POLLUTANTS = ("Brand#2", "Brand#19")
FACTS = ("Brand#2", "Brand#19", "Brand#99")
MIN_READINGS = 400
SELECTION = (STATES, YEARS, POLLUTANTS)

Query = Callable[[SparkSession, str], DataFrame]


def band_counts(df: DataFrame) -> DataFrame:
    """``band, readings, lowest, highest`` of the band each value falls in."""
    return (
        df.filter(F.col(VALUE).isNotNull())
        .groupBy(aqi_band(F.col(VALUE)).alias("band"))
        .agg(n_rows().alias("readings"), F.min(VALUE).alias("lowest"), F.max(VALUE).alias("highest"))
        .orderBy("lowest")
    )


# Operator on the cleaned readings, by query name.
OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "aqi_band": band_counts,
    "list_states": catalog.list_states,
    "list_years": catalog.list_years,
    "list_pollutants": catalog.list_pollutants,
    "dataset_profile": catalog.dataset_profile,
    "default_filters": lambda df: catalog.default_filters(df, STATES, POLLUTANTS),
    "default_filters_fallback": catalog.default_filters,
    "national_kpis": overview.national_kpis,
    "status_counts": overview.status_counts,
    "status_share_table": overview.status_share_table,
    "status_pie_share": overview.status_pie_share,
    "monthly_mean": overview.monthly_mean,
    "worst_state": overview.worst_state,
    "best_state": overview.best_state,
    "worst_area": overview.worst_area,
    "severe_share": overview.severe_share,
    "pollutant_share": lambda df: overview.pollutant_share(df, POLLUTANTS[0]),
    "year_month_mean": lambda df: trends.year_month_mean(df, YEARS),
    "season_mean": trends.season_mean,
    "season_status_share": trends.season_status_share,
    "season_status_wide": trends.season_status_wide,
    "season_status_stack": trends.season_status_stack,
    "year_month_matrix": lambda df: trends.year_month_matrix(df, (*YEARS, 2001)),
    "month_status_share": trends.month_status_share,
    "month_status_wide": trends.month_status_wide,
    "month_status_stack": trends.month_status_stack,
    "annual_summary": lambda df: trends.annual_summary(df, (*YEARS, 2022)),
    "annual_summary_text": lambda df: trends.annual_summary_text(df, YEARS),
    "state_ranking": regions.state_ranking,
    "area_ranking": lambda df: regions.area_ranking(df, MIN_READINGS),
    "top_areas": lambda df: regions.top_areas(df, 10, MIN_READINGS),
    "bottom_areas": lambda df: regions.bottom_areas(df, 10, MIN_READINGS),
    "state_slice": lambda df: regions.state_slice(df, STATE),
    "state_cards": lambda df: regions.state_cards(df, STATE),
    "state_month_profile": lambda df: regions.state_month_profile(df, STATE),
    "state_area_ranking": lambda df: regions.state_area_ranking(df, STATE),
    "state_status_breakdown": lambda df: regions.state_status_breakdown(df, STATE),
    "top_pollutants": pollutants.top_pollutants,
    "pollutant_mean": pollutants.pollutant_mean,
    "pollutant_status_matrix": pollutants.pollutant_status_matrix,
    "season_pollutant_share": pollutants.season_pollutant_share,
    "season_pollutant_grid": pollutants.season_pollutant_grid,
    "season_pollutant_wide": pollutants.season_pollutant_wide,
    "state_pollutant_counts": pollutants.state_pollutant_counts,
    "state_pollutant_share": pollutants.state_pollutant_share,
    "pollutant_facts": lambda df: pollutants.pollutant_facts(df, FACTS),
    "filter_readings": lambda df: explore.filter_readings(df, *SELECTION),
    "filtered_kpis": lambda df: explore.filtered_kpis(df, *SELECTION),
    "slice_kpis": explore.slice_kpis,
    "value_histogram": explore.value_histogram,
    "filtered_histogram": lambda df: explore.filtered_histogram(df, *SELECTION),
    "filtered_status_counts": lambda df: explore.filtered_status_counts(df, *SELECTION),
    "state_comparison": lambda df: explore.state_comparison(df, *SELECTION),
    "filtered_monthly_mean": lambda df: explore.filtered_monthly_mean(df, *SELECTION),
    "preview_rows": explore.preview_rows,
    "reproducible_means": summary.reproducible_means,
    "preview_count": lambda df: explore.preview_count(explore.filter_readings(df, *SELECTION)),
}


def _on_stored(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(tables.readings(spark, sf_dir))


# (application, tables) -> folders of partial sums
_sums: dict[tuple, list[str]] = {}


def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, states and statuses from two stored tables of partial sums, merged by addition.

    The tables are made once per application, from the readings of even and odd years.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if not store.whole(spark, *_sums.get(key, [])):
        df = tables.readings(spark, sf_dir)
        even = F.coalesce(F.col("year") % 2 == 0, F.lit(True))
        parts = [summary.partial_sums(df.filter(even)), summary.partial_sums(df.filter(~even))]
        if store.work_folder(spark) is None:
            return summary.summary_report(summary.merge_sums(*parts))
        folders = [store.new_folder(spark, "sums") for _ in parts]
        for part, folder in zip(parts, folders):
            part.write.parquet(folder)
        store.note(spark, *folders)
        _sums[key] = folders
    return summary.summary_report(summary.merge_sums(*[spark.read.parquet(folder) for folder in _sums[key]]))


# (application, tables) -> folder of bitmaps
_bitmaps: dict[tuple, str] = {}


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sites per month, quarter and of all time from bitmaps that are stored once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bitmaps or not store.whole(spark, _bitmaps[key]):
        df = tables.readings(spark, sf_dir)
        made = sites.site_bitmaps(df, sites.site_codes(df))
        if store.work_folder(spark) is None:
            return sites.site_counts(made)
        folder = store.new_folder(spark, "bitmaps")
        made.write.parquet(folder)
        store.note(spark, folder)
        _bitmaps[key] = folder
    return sites.site_counts(spark.read.parquet(_bitmaps[key]))


# (application, tables) -> folder of the clustered copy
_clustered: dict[tuple, str] = {}
CLUSTER_FILES = 64
FIRST_DAY, LAST_DAY = dt.date(1996, 3, 1), dt.date(1997, 8, 31)


def clustered_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state and pollutant over some seasons, from the files that the zone table names."""
    df = tables.readings(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _clustered or not store.whole(spark, _clustered[key]):
        if store.work_folder(spark) is None:
            chosen = (F.col("state") == STATE) & (F.col("primary_pollutant") == POLLUTANTS[0])
            return df.filter(chosen & F.col("date").between(F.lit(FIRST_DAY), F.lit(LAST_DAY)))
        folder = store.new_folder(spark, "clustered")
        clustered.write_clustered(df, folder, CLUSTER_FILES)
        store.note(spark, folder)
        _clustered[key] = folder
    return clustered.clustered_slice(spark, _clustered[key], df.schema, [STATE], FIRST_DAY, LAST_DAY, POLLUTANTS[:1])


def footer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, values and their bounds per year from the footers of the stored table."""
    df = tables.readings(spark, sf_dir)
    path = store.stored_path(spark, sf_dir)
    return footers.profile_of(df) if path is None else footers.footer_profile(spark, path, df.schema)


def queries() -> dict[str, Query]:
    """Every query: the two loading ones, then the operators on the stored table."""
    return {
        "clean_readings": tables.cleaned_readings,
        "read_readings": tables.readings_through_csv,
        "readings_incremental": tables.readings_incremental,
        "summary_rollup": summary_rollup,
        "site_counts": site_counts,
        "footer_profile": footer_profile,
        "clustered_slice": clustered_slice,
        "rejected_cells": lambda spark, sf_dir: rejects.reject_counts(tables.damaged_intake(spark, sf_dir).rejects),
        **{name: _on_stored(operator) for name, operator in OPERATORS.items()},
    }
