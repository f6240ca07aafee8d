"""The plans that make the operators fit a large table."""

from __future__ import annotations

import re

import pytest

import airq
from airq.plans import registry
from inspect_plans import final_plan, scans
from airq.sources import tables

SF = "/root/testdata/sf0.01"

# Column sets of their own, each read once. The preview reads dates first, then the
# newest days, then the rows without a date.
SCANS = {"preview_rows": 3, "default_filters": 3, "default_filters_fallback": 3,
         "annual_summary": 2, "annual_summary_text": 2}
TOP_K = ["worst_state", "best_state", "worst_area", "top_areas", "bottom_areas",
         "state_area_ranking", "top_pollutants", "pollutant_mean", "pollutant_status_matrix",
         "preview_rows"]


# Operators that return readings.
WHOLE_ROWS = {"state_slice", "filter_readings", "preview_rows"}


@pytest.fixture(scope="module")
def df(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return tables.readings(spark, SF)


@pytest.fixture(scope="module")
def plans(df):
    return {name: final_plan(operator(df)) for name, operator in registry.OPERATORS.items()}


@pytest.mark.parametrize("name", registry.OPERATORS)
def test_one_scan_and_no_pair_joins(plans, name):
    plan = plans[name]
    text = "\n".join(plan)
    assert sum(line.startswith("FileScan") for line in plan) == SCANS.get(name, 1)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SortMergeJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_without_a_full_sort(plans, name):
    assert any("TakeOrderedAndProject" in line for line in plans[name])


@pytest.mark.parametrize("name", set(registry.OPERATORS) - WHOLE_ROWS)
def test_readings_are_hash_aggregated_before_the_shuffle(plans, name):
    """No reading crosses the network and none is sorted, only partial results."""
    plan = plans[name]
    for at in (i for i, line in enumerate(plan) if line.startswith("FileScan")):
        shuffle = max(i for i in range(at) if plan[i].startswith("Exchange"))
        stage = "\n".join(plan[shuffle:at])
        assert "HashAggregate" in stage
        assert "SortAggregate" not in stage and "Sort [" not in stage


def scan_line(df):
    return next(line for line in final_plan(df) if line.startswith("FileScan"))


def test_filters_reach_the_scan(df):
    line = scan_line(airq.filter_readings(df, ["NATION_0"], [1996, 1997], ["Brand#2"]))
    assert re.search(r"PartitionFilters: \[year#\d+ IN \(1996,1997\)", line)
    assert "year" not in line.split("PushedFilters")[1]
    for column in ("state", "primary_pollutant"):
        assert f"IsNotNull({column})" in line


@pytest.mark.parametrize("operator, columns", [
    (airq.monthly_mean, {"date", "aqi_value"}),
    (airq.national_kpis, {"state", "area", "aqi_value", "air_quality_status"}),
    (airq.list_states, {"state"}),
    (airq.list_years, set()),
    (airq.status_share_table, {"air_quality_status"}),
    (airq.state_pollutant_share, {"state", "primary_pollutant"}),
])
def test_only_used_columns_are_read(df, operator, columns):
    schema = scan_line(operator(df)).split("ReadSchema: struct<")[1].split(">")[0]
    assert {field.split(":")[0] for field in schema.split(",") if field} == columns


def test_preview_skips_old_files(df):
    lines = [x for x in final_plan(airq.preview_rows(df, 20)) if x.startswith("FileScan")]
    assert any(re.search(r"DataFilters: \[.*date#\d+ >= ", x) for x in lines)
    assert any("ReadSchema: struct<date:date>" in x for x in lines)
    pruned = [x for x in lines if re.search(r"PartitionFilters: \[[^\]]*year#", x)]
    assert len(pruned) == 2, lines


def test_slice_kpis_shuffles_readings_once(df):
    plan = final_plan(airq.slice_kpis(df))
    assert sum("hashpartitioning(aqi_value" in line and line.startswith("Exchange") for line in plan) == 1


@pytest.mark.parametrize("name", registry.OPERATORS)
def test_frames_are_built_without_a_job(spark, df, name):
    group = f"building {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        registry.OPERATORS[name](df)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert not list(jobs)


@pytest.mark.parametrize("name", registry.OPERATORS)
def test_no_pair_joins_without_broadcasts(spark, df, name):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in settings:
        spark.conf.set(key, "-1")
    try:
        text = "\n".join(final_plan(registry.OPERATORS[name](df)))
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_counter_counts_repeated_scans(df):
    once = df.groupBy("state").count()
    assert scans(once) == 1
    assert scans(once.unionByName(df.groupBy("area").count().withColumnRenamed("area", "state"))) == 2
