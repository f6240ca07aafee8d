"""Option lists, dataset profile and default selections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.functions.measures import n_rows
from airq.schema import (
    AREA,
    DEFAULT_POLLUTANTS,
    DEFAULT_STATES,
    POLLUTANT,
    STATE,
    YEAR,
)


def _options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def list_states(df: DataFrame) -> DataFrame:
    """Distinct states, sorted."""
    return _options(df, STATE).orderBy(STATE)


def list_years(df: DataFrame) -> DataFrame:
    """Distinct years, sorted."""
    return _options(df, YEAR).orderBy(YEAR)


def list_pollutants(df: DataFrame) -> DataFrame:
    """Distinct primary pollutants, sorted."""
    return _options(df, POLLUTANT).orderBy(POLLUTANT)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: ``readings, states, areas, first_year, last_year``.

    Readings are combined per (state, area) first. Two distinct counts over the
    readings themselves would triple every row before the aggregation.
    """
    per_area = df.groupBy(STATE, AREA).agg(
        n_rows().alias("n"), F.min(YEAR).alias("first"), F.max(YEAR).alias("last")
    )
    return per_area.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("readings"),
        F.count_distinct(STATE).alias("states"),
        F.count_distinct(AREA).alias("areas"),
        F.min("first").alias("first_year"),
        F.max("last").alias("last_year"),
    )


def _preferred_or_first(df: DataFrame, column: str, preferred: Sequence[str]) -> DataFrame:
    """One row with ``preferred`` when its first value occurs, else as many first options.

    The first preferred value sorts before all others, so the few rows that
    survive the limit tell both whether it occurs and what the first options are.
    """
    hit = F.col(column) == preferred[0]
    first = _options(df, column).orderBy(hit.desc(), column).limit(len(preferred))
    return first.agg(
        F.when(F.max(hit), F.array(*[F.lit(p) for p in preferred]))
        .otherwise(F.array_sort(F.collect_list(column)))
        .alias("chosen")
    )


def _as_selection(chosen: DataFrame, name: str) -> DataFrame:
    return chosen.select(
        F.lit(name).alias("selection"), F.posexplode("chosen").alias("position", "value")
    )


def default_filters(
    df: DataFrame,
    states: Sequence[str] = DEFAULT_STATES,
    pollutants: Sequence[str] = DEFAULT_POLLUTANTS,
) -> DataFrame:
    """Preselected filter values as ``selection, position, value``.

    Selections: ``states`` and ``pollutants`` (the preferred ones if the first
    of them occurs, else the first two that do), ``years`` (all) and ``state``
    (the preferred one, else the first).
    """
    years = _options(df, YEAR).agg(F.array_sort(F.collect_list(YEAR)).alias("chosen"))
    chosen_states = _preferred_or_first(df, STATE, states)
    parts = [
        _as_selection(chosen_states, "states"),
        _as_selection(years.select(F.col("chosen").cast("array<string>")), "years"),
        _as_selection(_preferred_or_first(df, POLLUTANT, pollutants), "pollutants"),
        _as_selection(chosen_states.select(F.slice("chosen", 1, 1).alias("chosen")), "state"),
    ]
    return reduce(DataFrame.unionByName, parts)
