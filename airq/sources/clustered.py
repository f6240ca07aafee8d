"""Readings clustered along a space-filling curve, with a zone table that says which files to open.

A row's place on the curve interleaves the bits of its state, date and pollutant, each as the share
of all rows that sort before its value, so that files are of one size whatever the distribution.
State has every second bit, as it is what slices ask for most. Rows are dealt by ranges of the curve,
one file per range, and a file then holds few states, a stretch of time and few pollutants: the
zone table has their bounds. A slice looks its files up there and opens no others.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airq.schema import DATE, POLLUTANT, STATE

#: Bits of a value's code, and whose bit comes next along the curve, from the top.
CODE_BITS = {STATE: 12, DATE: 6, POLLUTANT: 6}
PATTERN = (STATE, DATE, STATE, POLLUTANT)
ZONED = (DATE, STATE, POLLUTANT)
PLACE = "_place"


def value_codes(readings: DataFrame, column: str) -> DataFrame:
    """``column, code``: the share of rows with a smaller value, in so many steps; missing values come first.

    Readings are counted per value first; one row per value, of which there are few (states, days,
    pollutants), is put in order.
    """
    steps = 1 << CODE_BITS[column]
    counted = readings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return counted.select(column, F.floor(before * steps / total).cast("long").alias(f"_{column}_code"))


def place_of(codes: dict[str, Column]) -> Column:
    """The codes' bits interleaved by ``PATTERN``, the top ones first."""
    left, place, at = dict(CODE_BITS), F.lit(0).cast("long"), sum(CODE_BITS.values())
    while at:
        for name in PATTERN:
            if left[name]:
                left[name] -= 1
                at -= 1
                bit = F.shiftright(codes[name], left[name]).bitwiseAND(F.lit(1))
                place = place.bitwiseOR(F.shiftleft(bit, at))
    return place


def write_clustered(readings: DataFrame, path: str, files: int) -> None:
    """Write ``readings`` as about ``files`` files along the curve to ``path/data``, and their bounds to ``path/zones``."""
    placed = readings
    for column in CODE_BITS:
        codes = value_codes(readings, column).withColumnRenamed(column, "_value")
        placed = placed.join(codes, placed[column].eqNullSafe(F.col("_value")), "left").drop("_value")
    placed = placed.withColumn(PLACE, place_of({c: F.col(f"_{c}_code") for c in CODE_BITS}))
    # The date breaks ties, so a state, day and pollutant with very many rows may span files.
    dealt = placed.repartitionByRange(files, PLACE, F.xxhash64(*readings.columns)).sortWithinPartitions(PLACE, DATE)
    dealt.select(*readings.columns).write.parquet(f"{path}/data")
    written = readings.sparkSession.read.schema(readings.schema).parquet(f"{path}/data")
    bounds = [f(c).alias(f"{name}_{c}") for c in ZONED for name, f in (("min", F.min), ("max", F.max))]
    held = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ZONED]
    zones = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("readings"), *bounds, *held)
    zones.coalesce(1).write.parquet(f"{path}/zones")  # a row per file


def zones_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file, readings``, bounds and missing values of date, state and pollutant."""
    return spark.read.parquet(f"{path}/zones")


def _meets(column: str, values: Sequence) -> Column:
    """Whether a file may hold one of ``values``."""
    low, high = F.col(f"min_{column}"), F.col(f"max_{column}")
    found = F.lit(False)
    for value in values:
        found = found | F.lit(value).between(low, high)
    return found


def clustered_slice(
    spark: SparkSession, path: str, schema: StructType, states: Sequence[str] | None = None,
    first_day: dt.date | None = None, last_day: dt.date | None = None, pollutants: Sequence[str] | None = None,
) -> DataFrame:
    """Readings of the given states, days (both included) and pollutants; what is None is not asked for.

    Missing values never match. Names of the files that the zone table lets through are collected: as many as the
    slice has to open.
    """
    zone, rows = F.lit(True), F.lit(True)
    for column, values in ((STATE, states), (POLLUTANT, pollutants)):
        if values is not None:
            zone, rows = zone & _meets(column, values), rows & F.col(column).isin(*values)
    if first_day is not None:
        zone, rows = zone & (F.col(f"max_{DATE}") >= F.lit(first_day)), rows & (F.col(DATE) >= F.lit(first_day))
    if last_day is not None:
        zone, rows = zone & (F.col(f"min_{DATE}") <= F.lit(last_day)), rows & (F.col(DATE) <= F.lit(last_day))
    files = [r[0] for r in zones_of(spark, path).filter(zone).select(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).filter(rows)
