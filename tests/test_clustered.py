"""The clustered layout: same rows, few files."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from airq.sources import clustered, tables

SF = "/root/testdata/sf0.01"
FILES = 96


def files_read(df):
    """Files the scan opened, by its own metric."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = tables.readings(spark, SF)
    path = str(tmp_path_factory.mktemp("clustered") / "a b%20+c")
    clustered.write_clustered(df, path, FILES)
    return df, path


@pytest.mark.parametrize("chosen", [
    {"states": ["NATION_0"]}, {"states": ["NATION_3", "NATION_24"], "pollutants": ["Brand#2"]}, {"pollutants": ["Brand#19"]},
    {"first_day": dt.date(1996, 3, 1), "last_day": dt.date(1996, 4, 2)}, {"states": ["NATION_1"], "first_day": dt.date(2000, 1, 1)},
    {"states": ["nowhere"]}, {"states": []}, {"last_day": dt.date(1990, 1, 1)}, {}])
def test_slices_hold_the_same_rows(spark, stored, chosen):
    df, path = stored
    want = df
    for column, key in (("state", "states"), ("primary_pollutant", "pollutants")):
        if key in chosen:
            want = want.filter(F.col(column).isin(*chosen[key]))
    if "first_day" in chosen:
        want = want.filter(F.col("date") >= F.lit(chosen["first_day"]))
    if "last_day" in chosen:
        want = want.filter(F.col("date") <= F.lit(chosen["last_day"]))
    got = clustered.clustered_slice(spark, path, df.schema, **chosen)
    assert got.columns == df.columns
    assert sorted(tuples(got), key=str) == sorted(tuples(want), key=str)


def test_a_state_opens_a_fifth_of_the_files_at_most(spark, stored):
    df, path = stored
    every = files_read(spark.read.schema(df.schema).parquet(f"{path}/data").filter("state = 'NATION_0'"))
    one = files_read(clustered.clustered_slice(spark, path, df.schema, ["NATION_0"]))
    month = files_read(clustered.clustered_slice(spark, path, df.schema, first_day=dt.date(1996, 3, 1), last_day=dt.date(1996, 3, 31)))
    assert every >= 80 and 5 * one <= every and 2 * month <= every


def test_files_are_of_one_size(spark, stored):
    df, path = stored
    sizes = [r.readings for r in clustered.zones_of(spark, path).collect()]
    assert sum(sizes) == df.count() and max(sizes) < 3 * sum(sizes) / FILES


def test_a_hot_cell_spans_files_and_missing_values_stay(spark, frame, sample, tmp_path):
    rows = [{**sample[0], "state": "Delhi", "primary_pollutant": "PM10", "aqi_value": float(i)} for i in range(900)] + sample[:600]
    df = frame(rows)
    clustered.write_clustered(df, str(tmp_path), 8)
    sizes = [r.readings for r in clustered.zones_of(spark, str(tmp_path)).collect()]
    assert max(sizes) < 500
    got = clustered.clustered_slice(spark, str(tmp_path), df.schema)
    assert sorted(tuples(got), key=str) == sorted(tuples(df), key=str)


def test_bits_are_interleaved_from_the_top(spark):
    codes = {"state": F.lit(0b100000000001), "date": F.lit(0b100000), "primary_pollutant": F.lit(0b000001)}
    place = spark.range(1).select(clustered.place_of(codes).alias("p")).first().p
    assert place == 0b110000000000000000000011
