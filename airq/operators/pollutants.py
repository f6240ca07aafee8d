"""Frequency of primary pollutants and their mix by status, season and state.

The readings are always counted first; picking the most frequent pollutants
then works on the counts, so no operator reads the table a second time to keep
the rows of the winners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airq.functions.frames import drop_null_key, highest_first, spine
from airq.functions.measures import counts_by_status, n_rows, percent
from airq.schema import (
    FACT_POLLUTANTS,
    POLLUTANT,
    SEASON,
    STATE,
    STATUS,
    STATUS_ORDER,
    VALUE,
)


def _named(df: DataFrame) -> DataFrame:
    return df.filter(F.col(POLLUTANT).isNotNull())


def _most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the most readings; ties go to the smaller name."""
    return counts.orderBy(*highest_first("readings", POLLUTANT)).limit(n)


def top_pollutants(df: DataFrame, n: int = 10) -> DataFrame:
    """``primary_pollutant, readings, rank`` of the ``n`` most frequent."""
    counts = _named(df).groupBy(POLLUTANT).agg(n_rows().alias("readings"))
    # The window sees n rows: the limit runs before it.
    rank = F.row_number().over(Window.orderBy(*highest_first("readings", POLLUTANT)))
    return _most_frequent(counts, n).withColumn("rank", rank)


def pollutant_mean(df: DataFrame, n: int = 10) -> DataFrame:
    """``primary_pollutant, mean_aqi`` of the ``n`` most frequent, highest first."""
    stats = _named(df).groupBy(POLLUTANT).agg(
        n_rows().alias("readings"), F.avg(VALUE).alias("mean_aqi")
    )
    return (
        _most_frequent(stats, n)
        .select(POLLUTANT, "mean_aqi")
        .orderBy(*highest_first("mean_aqi", POLLUTANT))
    )


def pollutant_status_matrix(df: DataFrame, n: int = 8) -> DataFrame:
    """``primary_pollutant`` and one count column per known status, absent = 0."""
    stats = _named(df).groupBy(POLLUTANT).agg(
        n_rows().alias("readings"), F.count(STATUS).alias("labelled"), *counts_by_status()
    )
    return (
        _most_frequent(stats, n)
        .filter("labelled > 0")
        .select(POLLUTANT, *STATUS_ORDER)
        .orderBy(POLLUTANT)
    )


def _counts_of_top(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Counts per (key, pollutant) of the ``n`` most frequent, and their names.

    Ranking counts every row of a pollutant, also those without a key. An inner
    join against the unique names is used: Spark would push a semi join below
    the aggregation and scan the readings again for it.
    """
    counts = _named(df).groupBy(key, POLLUTANT).agg(n_rows().alias("readings"))
    names = _most_frequent(
        counts.groupBy(POLLUTANT).agg(F.sum("readings").alias("readings")), n
    ).select(POLLUTANT)
    return counts.join(names, POLLUTANT), names


def _grid(df: DataFrame, key: str, n: int) -> DataFrame:
    """``key, primary_pollutant, readings`` with a row for every pair, absent = 0.

    Each key carries its at most ``n`` counts in a map, so filling the gaps is a
    lookup per row and needs no join.
    """
    counts, names = _counts_of_top(df, key, n)
    per_key = drop_null_key(counts, key, "readings").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(POLLUTANT, "readings"))).alias("tally")
    )
    listed = names.agg(F.collect_list(POLLUTANT).alias("names")).scalar()
    return (
        per_key.withColumn("names", listed)
        .select(key, "tally", F.explode_outer("names").alias(POLLUTANT))
        .select(
            key, POLLUTANT,
            F.coalesce(F.try_element_at("tally", F.col(POLLUTANT)), F.lit(0)).alias("readings"),
        )
    )


def _share_of(df: DataFrame, key: str) -> DataFrame:
    total = F.sum("readings").over(Window.partitionBy(key))
    return df.withColumn("pct", percent(F.col("readings"), total))


def season_pollutant_share(df: DataFrame, n: int = 6) -> DataFrame:
    """``season, primary_pollutant, readings, pct`` inside the top ``n``."""
    counts, _ = _counts_of_top(df, SEASON, n)
    return (
        _share_of(drop_null_key(counts, SEASON, "readings"), SEASON)
        .select(SEASON, POLLUTANT, "readings", "pct")
        .orderBy(SEASON, POLLUTANT)
    )


def season_pollutant_grid(df: DataFrame, n: int = 6) -> DataFrame:
    """``season, primary_pollutant, pct`` with every pair, absent = 0."""
    return (
        _share_of(_grid(df, SEASON, n), SEASON)
        .select(SEASON, POLLUTANT, "pct")
        .orderBy(SEASON, POLLUTANT)
    )


def season_pollutant_wide(df: DataFrame, n: int = 6) -> DataFrame:
    """``season, name_1, pct_1 .. name_n, pct_n``: the top pollutants in alphabetical order.

    The columns do not depend on the data; with fewer than ``n`` pollutants the last
    ones are NULL. Each season carries its at most ``n`` shares in one sorted array.
    """
    shares = _share_of(_grid(df, SEASON, n), SEASON).groupBy(SEASON).agg(
        F.array_sort(F.collect_list(F.struct(POLLUTANT, "pct"))).alias("cells")
    )
    columns = []
    for i in range(n):
        cell = F.get("cells", F.lit(i))
        columns += [cell[POLLUTANT].alias(f"name_{i + 1}"), cell["pct"].alias(f"pct_{i + 1}")]
    return shares.select(SEASON, *columns).orderBy(SEASON)


def state_pollutant_counts(df: DataFrame, n: int = 6) -> DataFrame:
    """``state, primary_pollutant, readings`` with every pair, absent = 0."""
    return _grid(df, STATE, n).orderBy(STATE, POLLUTANT)


def state_pollutant_share(df: DataFrame, n: int = 6) -> DataFrame:
    """``state, primary_pollutant, pct`` of the state's rows in the top ``n``."""
    return (
        _share_of(_grid(df, STATE, n), STATE)
        .select(STATE, POLLUTANT, "pct")
        .orderBy(STATE, POLLUTANT)
    )


def pollutant_facts(df: DataFrame, names: Sequence[str] = FACT_POLLUTANTS) -> DataFrame:
    """``primary_pollutant, readings, mean_aqi`` of named pollutants, 0 / NULL if absent."""
    stats = df.filter(F.col(POLLUTANT).isin(*names)).groupBy(POLLUTANT).agg(
        n_rows().alias("n"), F.avg(VALUE).alias("mean_aqi")
    )
    return (
        spine(df.sparkSession, POLLUTANT, names)
        .join(stats, POLLUTANT, "left")
        .orderBy("position")
        .select(POLLUTANT, F.coalesce("n", F.lit(0)).alias("readings"), "mean_aqi")
    )
