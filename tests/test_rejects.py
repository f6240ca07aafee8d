"""Rejected cells and records: counted in the pass that cleans, kept with their file."""

from __future__ import annotations

import os

import pytest
from conftest import tuples

from airq.plans import registry
from airq.sources import rejects
from airq.sources.readings import clean_readings

HEADER = "date,state,area,number_of_monitoring_stations,prominent_pollutants,aqi_value,air_quality_status,note"
GOOD = ["5-3-2024, Delhi ,Area A,2,PM10,120,Moderate,x", "NA,Goa,Area B,,PM10,,Good,", "2024-01-05,Goa,,1.0,CO,1e2,NA,y"]
BAD = ["31-02-2024,Goa,A,1,CO,10,Good,", " yesterday ,Goa,A,x,CO,12a,Great,", "5-3-2024,Goa,A,1.5,CO,inf,Good,"]
BROKEN = ["5-3-2024,Goa", "5-3-2024,Goa,A,1,CO,1,Good,,,extra"]


def write(folder, name, lines):
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")


def test_cells_and_records_are_kept_with_their_file(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.csv", GOOD + BAD[:1])
    write(source, "b.csv", BAD[1:] + BROKEN)
    got = rejects.take_in(spark, str(source), str(tmp_path / "out"))
    rows = sorted((os.path.basename(r.file), r.column, r.cell, r.reason) for r in got.rejects.collect())
    assert rows == sorted([
        ("a.csv", "date", "31-02-2024", "not a date"), ("b.csv", "date", " yesterday ", "not a date"),
        ("b.csv", "number_of_monitoring_stations", "x", "not a whole number"), ("b.csv", "aqi_value", "12a", "not a number"),
        ("b.csv", "air_quality_status", "Great", "not a known status"),
        ("b.csv", "number_of_monitoring_stations", "1.5", "not a whole number"), ("b.csv", "aqi_value", "inf", "not a number"),
        *[("b.csv", "record", line, "does not fit the header") for line in BROKEN]])
    assert got.counts == {"rows": 8, "record": 2, "date": 2, "aqi_value": 2, "number_of_monitoring_stations": 2, "air_quality_status": 1}
    assert {(r.column, r.reason): r.cells for r in rejects.reject_counts(got.rejects).collect()}["date", "not a date"] == 2
    want = tmp_path / "want"
    want.mkdir()
    write(want, "c.csv", GOOD + BAD)
    full = clean_readings(spark, str(want))
    assert got.readings.schema == full.schema
    assert sorted(tuples(got.readings), key=str) == sorted(tuples(full), key=str)


def test_files_are_read_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.csv", GOOD + BAD)
    got = rejects.take_in(spark, str(source), str(tmp_path / "out"))
    os.remove(source / "a.csv")
    assert got.readings.count() == 6 and got.rejects.count() == 7 and got.counts["rows"] == 6


@pytest.mark.parametrize("lines", [[], GOOD])
def test_nothing_rejected(spark, tmp_path, lines):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.csv", lines)
    got = rejects.take_in(spark, str(source), str(tmp_path / "out"))
    assert got.rejects.collect() == [] and got.counts == {
        "rows": len(lines), "record": 0, "date": 0, "aqi_value": 0, "number_of_monitoring_stations": 0, "air_quality_status": 0}
    assert got.readings.count() == len(lines)


def test_query_counts_what_was_damaged(spark):
    got = {r.column: r.cells for r in registry.queries()["rejected_cells"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"date", "aqi_value", "number_of_monitoring_stations", "air_quality_status"} and min(got.values()) > 0
