"""Distinct counts from bitmaps, and answers from file footers."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import reading, tuples
from pyspark.sql import functions as F

from airq.operators import sites
from airq.plans import registry
from airq.sources import footers, store, tables
from inspect_plans import final_plan

SF = "/root/testdata/sf0.001"


def brute(rows):
    held = defaultdict(set)
    for r in rows:
        if r["state"] is None or r["area"] is None:
            continue
        site, day = (r["state"], r["area"]), r["date"]
        held["all", "all"].add(site)
        if day:
            held["month", str(day.replace(day=1))].add(site)
            held["quarter", str(day.replace(day=1, month=(day.month - 1) // 3 * 3 + 1))].add(site)
    return sorted((part, label, len(s)) for (part, label), s in held.items())


def test_counts_equal_sets_whatever_is_merged(spark, frame, sample):
    parts = [frame(sample[a::3]) for a in range(3)]
    codes = sites.site_codes(parts[0])
    for part in parts[1:]:
        codes = sites.site_codes(part, codes)
    merged = sites.merge_bitmaps(*[sites.site_bitmaps(p, codes) for p in parts])
    assert sorted(tuples(sites.site_counts(merged))) == brute(sample)
    one = frame(sample)
    assert sorted(tuples(sites.site_counts(sites.site_bitmaps(one, sites.site_codes(one))))) == brute(sample)


def test_codes_of_known_sites_stay_and_new_ones_follow(spark, frame):
    first = sites.site_codes(frame([reading(state="B", area="x"), reading(state="A", area="y"), reading(state=None, area="z")]))
    assert sorted(tuples(first)) == [("A", "y", 1), ("B", "x", 2)]
    both = sites.site_codes(frame([reading(state="A", area="a"), reading(state="B", area="x")]), first)
    assert sorted(tuples(both)) == [("A", "a", 3), ("A", "y", 1), ("B", "x", 2)]


def test_more_sites_than_one_bitmap_holds(spark):
    df = spark.range(100_000).selectExpr("CAST('2024-01-05' AS DATE) AS date", "'S' AS state", "CAST(id AS STRING) AS area")
    maps = sites.site_bitmaps(df, sites.site_codes(df))
    assert maps.count() == 4 and {r.sites for r in sites.site_counts(maps).collect()} == {100_000}


def test_unknown_sites_and_empty_tables(spark, frame, sample_df):
    with pytest.raises(Exception, match="without a code"):
        sites.site_bitmaps(sample_df, sites.site_codes(sample_df.limit(0))).collect()
    none = sample_df.limit(0)
    assert sites.site_counts(sites.site_bitmaps(none, sites.site_codes(none))).collect() == []


def test_counts_read_bitmaps_and_no_readings(spark):
    plan = final_plan(registry.site_counts(spark, SF))
    scans = [line for line in plan if line.startswith("FileScan")]
    assert len(scans) == 1 and "bitmap" in scans[0] and "aqi_value" not in scans[0]


def test_profile_is_answered_by_footers(spark):
    df = tables.readings(spark, SF)
    got = footers.footer_profile(spark, store.stored_path(spark, SF), df.schema)
    plan = "\n".join(final_plan(got))
    assert "PushedAggregation: [COUNT(*), COUNT(aqi_value), MIN(aqi_value)" in plan and "PushedGroupBy: [year]" in plan
    # One row per file comes out of the scan, not one per reading.
    files = len(df.inputFiles())
    scanned = rows_of_scans(got._jdf.queryExecution().executedPlan())
    assert 0 < scanned <= files < df.count()
    assert sorted(tuples(got), key=str) == sorted(tuples(footers.profile_of(df)), key=str)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def rows_of_scans(node):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_of_scans(node.executedPlan())
    if "QueryStage" in name:
        return rows_of_scans(node.plan())
    if name.startswith("BatchScan"):
        return node.metrics().apply("numOutputRows").value()
    children = node.children()
    return sum(rows_of_scans(children.apply(i)) for i in range(children.size()))


def test_what_footers_do_not_tell_is_read(spark):
    df = tables.readings(spark, SF)
    got = footers.from_footers(spark, store.stored_path(spark, SF), df.schema, [F.avg("aqi_value").alias("mean"), F.count(F.lit(1)).alias("n")])
    assert tuples(got) == tuples(df.agg(F.avg("aqi_value"), F.count(F.lit(1))))
