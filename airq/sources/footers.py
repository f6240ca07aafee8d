"""Counts, minima and maxima of a stored table from file footers, without reading a row.

Spark's second Parquet source answers such aggregates from the statistics that every file
carries, if it may: settings of the session say which source reads ``parquet`` and whether aggregates
are pushed down. They are looked at when the table is opened and when the query is
planned, so both happen here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airq.schema import STATIONS, VALUE, YEAR

_SETTINGS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def _pushed_down(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def from_footers(spark: SparkSession, path: str, schema: StructType, aggregates: list[Column], by: str | None = None) -> DataFrame:
    """``aggregates`` (counts, minima, maxima) of the table at ``path``, by a folder column if one is given.

    The plan is made here, with the settings it needs, and run later. Whatever the
    footers do not tell is read as usual; so is everything by a frame that is built on top of this one, which
    is planned anew under the session's own settings.
    """
    with _pushed_down(spark):
        table = spark.read.schema(schema).parquet(path)
        # Only numbers and dates have exact bounds in a footer; text is cut there.
        found = table.groupBy(by).agg(*aggregates) if by else table.agg(*aggregates)
        found._jdf.queryExecution().executedPlan()
    return found


def _profile() -> list[Column]:
    return [F.count(F.lit(1)).alias("readings"), F.count(VALUE).alias("measured"), F.min(VALUE).alias("lowest"),
            F.max(VALUE).alias("highest"), F.max(STATIONS).alias("most_stations")]


def footer_profile(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``year, readings, measured, lowest, highest, most_stations`` of every year of a stored table."""
    return from_footers(spark, path, schema, _profile(), YEAR)


def profile_of(readings: DataFrame) -> DataFrame:
    """``footer_profile`` of readings that are not stored."""
    return readings.groupBy(YEAR).agg(*_profile())
