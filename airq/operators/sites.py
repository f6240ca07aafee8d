"""Distinct counts of sites that merge: bitmaps over a dictionary of sites.

A site is an area of a state. The dictionary gives every site a number; a month's bitmap has the
bits of the sites that reported in it. Bitmaps of months, files or snapshots are merged by OR,
so counts over any of them put together need the bitmaps alone and no readings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airq.schema import AREA, DATE, STATE

MONTH_START, CODE, BUCKET, BITMAP = "month_start", "code", "bucket", "bitmap"


def site_codes(readings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``state, area, code``: every site with a number from 1, those of ``known`` unchanged.

    New sites are numbered behind the known ones in order of their names. One row per site
    is sorted in one task, after the readings were combined.
    """
    sites = readings.filter(F.col(STATE).isNotNull() & F.col(AREA).isNotNull()).select(STATE, AREA).distinct()
    behind = F.row_number().over(Window.orderBy(STATE, AREA)).cast("long")
    if known is None:
        return sites.withColumn(CODE, behind)
    last = F.coalesce(known.agg(F.max(CODE)).scalar(), F.lit(0))
    new = sites.join(known, [STATE, AREA], "left_anti").withColumn(CODE, behind + last)
    return known.select(STATE, AREA, CODE).unionByName(new)


def site_bitmaps(readings: DataFrame, codes: DataFrame) -> DataFrame:
    """``month_start, bucket, bitmap``: the sites of every month; readings without a date are a month of their own.

    A bitmap covers some 32,000 sites in 4 KB; more sites have more buckets. Readings are
    combined per month and site before they meet the dictionary. Sites that the dictionary does not
    know raise.
    """
    pairs = readings.filter(F.col(STATE).isNotNull() & F.col(AREA).isNotNull()).select(
        F.trunc(DATE, "MM").alias(MONTH_START), STATE, AREA).distinct()
    coded = pairs.join(codes, [STATE, AREA], "left").withColumn(
        CODE, F.when(F.col(CODE).isNotNull(), F.col(CODE)).otherwise(
            F.raise_error(F.concat(F.lit("a site without a code: "), STATE, F.lit(", "), AREA)).cast("long")))
    return coded.groupBy(MONTH_START, F.bitmap_bucket_number(CODE).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(CODE)).alias(BITMAP))


def merge_bitmaps(*tables: DataFrame) -> DataFrame:
    """One table of bitmaps from several, over readings that may share sites."""
    return reduce(DataFrame.unionByName, tables).groupBy(MONTH_START, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def site_counts(bitmaps: DataFrame) -> DataFrame:
    """``part, label, sites``: exact distinct sites per month, per quarter and of all time, from bitmaps alone.

    Readings without a date count for all time only.
    """
    quarter = F.trunc(MONTH_START, "QUARTER")
    marked = bitmaps.select(F.col(BUCKET), F.col(BITMAP), F.explode(F.array(
        F.struct(F.lit("month").alias("part"), F.col(MONTH_START).cast("string").alias("label")),
        F.struct(F.lit("quarter").alias("part"), quarter.cast("string").alias("label")),
        F.struct(F.lit("all").alias("part"), F.lit("all").alias("label")))).alias("of")).select("of.*", BUCKET, BITMAP)
    merged = marked.filter(F.col("label").isNotNull()).groupBy("part", "label", BUCKET).agg(
        F.bitmap_count(F.bitmap_or_agg(BITMAP)).alias("held"))
    return merged.groupBy("part", "label").agg(F.sum("held").alias("sites"))
