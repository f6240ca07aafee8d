"""Partial aggregates that merge by addition, and what is answered from them alone.

One row per month, state, area, pollutant, status and level of exact sums (see
``airq.functions.exact``) holds the rows, the values and their digits. Tables of such rows are
merged by adding up; every coarser grouping is a sum of theirs. Readings are scanned once,
when a table is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from airq.functions.exact import LEVEL, NAMES, digit_sums, totals_of, with_digits
from airq.functions.frames import with_row
from airq.functions.measures import n_rows, percent, ratio
from airq.schema import AREA, DATE, POLLUTANT, STATE, STATUS, VALUE
from airq.sources import snapshots

MONTH_START = "month_start"
KEYS = (MONTH_START, STATE, AREA, POLLUTANT, STATUS)
COUNTS = ("readings", "measured")


def partial_sums(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, level, readings, measured`` and digits of the sum of values."""
    rows = with_digits(readings.withColumn(MONTH_START, F.trunc(DATE, "MM")), VALUE)
    return rows.groupBy(*keys, LEVEL).agg(n_rows().alias("readings"), F.count(VALUE).alias("measured"), *digit_sums())


def merge_sums(*tables: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One table of partial sums from several, over readings that they do not share."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(*keys, LEVEL).agg(*[F.sum(c).alias(c) for c in COUNTS], *digit_sums())


def rollup_sums(sums: DataFrame, groupings: dict[str, str]) -> DataFrame:
    """``part, label, readings, measured, mean_aqi`` of several groupings at once.

    ``groupings`` names a key column per part. Partial rows pass once, in grouping sets.
    """
    columns = [F.col(c) for c in groupings.values()]
    sets = [[c, F.col(LEVEL)] for c in columns]
    part = F.element_at(F.create_map(*[
        x for i, name in enumerate(groupings) for x in (F.lit(i), F.lit(name))]), F.col("place"))
    # The bit of a column is 0 in the set that groups by it.
    place = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(i)) for i, c in enumerate(columns)])
    label = F.coalesce(*[F.when(F.grouping(c) == 0, c.cast("string")) for c in columns])
    rolled = sums.groupingSets(sets, *columns, F.col(LEVEL)).agg(
        place.alias("place"), label.alias("label"), *[F.sum(c).alias(c) for c in COUNTS], *digit_sums()
    ).select("place", "label", LEVEL, *COUNTS, *NAMES)
    return totals_of(rolled, ["place", "label"], COUNTS).select(
        part.alias("part"), "label", *COUNTS, ratio(F.col("total"), F.col("measured")).alias("mean_aqi"))


def summary_report(sums: DataFrame) -> DataFrame:
    """``part, label, readings, mean_aqi, pct``: months, states and statuses in one answer.

    ``pct`` is the share of all rows. Rows without a key count in that whole and form no group.
    """
    rolled = rollup_sums(sums, {"month": MONTH_START, "state": STATE, "status": STATUS})
    # Every row is in exactly one group of each part.
    whole = rolled.filter("part = 'month'").agg(F.sum("readings").alias("whole"))
    return with_row(rolled.filter("label IS NOT NULL"), whole).select(
        "part", "label", "readings", "mean_aqi", percent(F.col("readings"), F.col("whole")).alias("pct"))


def reproducible_means(readings: DataFrame) -> DataFrame:
    """``part, label, measured, mean_aqi`` by month, state, area and pollutant, to the last bit the same however
    rows are dealt."""
    rolled = rollup_sums(partial_sums(readings, (MONTH_START, STATE, AREA, POLLUTANT)), {
        "month": MONTH_START, "state": STATE, "area": AREA, "pollutant": POLLUTANT})
    return rolled.filter("label IS NOT NULL").select("part", "label", "measured", "mean_aqi")


def snapshot_sums(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Partial sums of a snapshot (see ``airq.sources.snapshots``), without reading what was summed before.

    Every batch of the table has its sums per file version beside it, written when they are
    first asked for. Those of replaced and removed files are left out.
    """
    rows = snapshots.manifest(spark, table, version)
    keys = (snapshots.SOURCE, *KEYS)
    parts = []
    for batch, dead in snapshots.batches(rows).items():
        path = f"{table}/summary/{batch}"
        if not snapshots.exists(spark, f"{path}/_SUCCESS"):
            made = partial_sums(snapshots.read_batch(spark, table, batch, version), keys)
            made.write.mode("overwrite").parquet(path)
        sums = spark.read.schema(_schema(keys)).parquet(path)
        parts.append(sums.filter(~F.col(snapshots.SOURCE).isin(dead)) if dead else sums)
    return merge_sums(*parts) if parts else spark.createDataFrame([], _schema(KEYS))


def _schema(keys: Sequence[str]) -> StructType:
    kinds = "month_start DATE" if MONTH_START in keys else ""
    text = StructType([StructField(k, StringType()) for k in keys if k != MONTH_START])
    longs = ", ".join([kinds, "level INT", *[f"{c} BIGINT" for c in (*COUNTS, *NAMES)]])
    return StructType([*text.fields, *StructType.fromDDL(longs).fields])
