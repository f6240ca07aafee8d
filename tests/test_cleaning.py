"""Loading and cleaning: every row of the edge table in FIXTURES.md."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import season, tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import airq
from airq.functions.cells import (
    aqi_band,
    first_listed,
    month_label,
    null_if_missing,
    parse_day_first,
    season_of,
    strip,
    to_count,
    to_number,
)
from airq.schema import CLEAN_SCHEMA, MONTH_LABELS, NULL_TOKENS, WHITESPACE
from airq.sources.readings import clean, clean_readings, drop_optional, read_readings

HEADER = "date,state,area,number_of_monitoring_stations,prominent_pollutants,aqi_value,air_quality_status"


def apply(spark, change, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(change(F.col("v"))).collect()]


def write_csv(folder, *lines, header=HEADER):
    folder.mkdir(exist_ok=True)
    (folder / "part.csv").write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(folder)


def test_dates(spark):
    texts = ["30-04-2025", "1-5-2024", "01-05-2024", "13/04/2025", "2025-04-05",
             "31-02-2025", "04-30-2025", "", "soon", None]
    want = [dt.date(2025, 4, 30), dt.date(2024, 5, 1), dt.date(2024, 5, 1), dt.date(2025, 4, 13),
            dt.date(2025, 4, 5), None, None, None, None, None]
    assert apply(spark, parse_day_first, texts) == want


def test_date_formats_are_a_parameter(spark):
    got = apply(spark, lambda c: parse_day_first(c, ["yyyyMMdd"]), ["20240229", "1-5-2024"])
    assert got == [dt.date(2024, 2, 29), None]


def test_every_null_token(spark):
    assert apply(spark, null_if_missing, NULL_TOKENS) == [None] * len(NULL_TOKENS)
    kept = [" NA ", "  ", "na", "Nan", "nil", "0"]
    assert apply(spark, null_if_missing, kept) == kept


def test_whitespace_is_what_python_strips():
    assert WHITESPACE == "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(
    st.text(alphabet=st.sampled_from(WHITESPACE + "aé 中,.~!\x7f\x00​"), max_size=8),
    min_size=1, max_size=60,
))
def test_strip_is_python_strip(spark, texts):
    assert apply(spark, strip, texts) == [t.strip() for t in texts]


def test_numbers(spark):
    texts = ["210", "210.5", ".5", "5.", "+7", "-3", "1e2", "abc", "", "12d", "12f", "0x1p3",
             "1,234", "1_000", "Infinity", "NaN", None, "1e999", "-1e999"]
    want = [210.0, 210.5, 0.5, 5.0, 7.0, -3.0, 100.0] + [None] * 12
    assert apply(spark, to_number, texts) == want


def test_counts(spark):
    texts = ["3", "3.0", "3.", "+4", "-1", "2.5", "99999999999", "x", "", None]
    assert apply(spark, to_count, texts) == [3, 3, 3, 4, -1, None, None, None, None, None]


def test_first_listed(spark):
    texts = ["PM10,PM2.5", " O3 , CO", ",PM10", "", "\tPM10 ", None]
    assert apply(spark, first_listed, texts) == ["PM10", "O3", "", "", "PM10", None]


def test_seasons_and_labels(spark):
    months = [*range(1, 13), None]
    assert apply(spark, season_of, months, "int") == [season(m) for m in months]
    assert apply(spark, month_label, months, "int") == [*MONTH_LABELS, None]


def test_bands(spark):
    values = [0.0, 50.0, 50.5, 100.0, 101.0, 200.0, 201.0, 300.0, 301.0, 400.0, 401.0, 999.0, None]
    want = ["Good", "Good", "Satisfactory", "Satisfactory", "Moderate", "Moderate", "Poor", "Poor",
            "Very Poor", "Very Poor", "Severe", "Severe", None]
    assert apply(spark, aqi_band, values, "double") == want


def test_csv_edges(spark, tmp_path):
    path = write_csv(
        tmp_path / "csv",
        '30-04-2025,"  Delhi\t",Central ,3,"PM10,PM2.5",210, Good,mg,"say ""hi"", ok"',
        '31-02-2025,NA,"  ",, ,abc,NULL,mg,',
        '1-5-2024, NA ,"say ""hi"", ok",2.0,"",,Severe ,,',
        header=HEADER + ",unit,note",
    )
    df = clean_readings(spark, path)
    assert df.schema.simpleString() == spark.createDataFrame([], CLEAN_SCHEMA).schema.simpleString()
    assert sorted(tuples(df), key=str) == sorted([
        (dt.date(2025, 4, 30), "Delhi", "Central", 3, "PM10,PM2.5", 210.0, "Good",
         2025, 4, "Pre-monsoon", "PM10"),
        (None, None, "", None, "", None, None, None, None, None, ""),
        (dt.date(2024, 5, 1), "NA", 'say "hi", ok', 2, None, None, "Severe",
         2024, 5, "Pre-monsoon", None),
    ], key=str)


def test_csv_binds_by_header_name(spark, tmp_path):
    names = HEADER.split(",")
    cells = dict(zip(names, ["2-1-2024", "Goa", "Panaji", "1", "O3", "40", "Good"]))
    order = list(reversed(names))
    path = write_csv(tmp_path / "csv", ",".join(cells[n] for n in order), header=",".join(order))
    row = clean_readings(spark, path).first()
    assert (row.state, row.area, row.aqi_value, row.month) == ("Goa", "Panaji", 40.0, 1)


def test_csv_with_other_header_in_a_second_file_fails(spark, tmp_path):
    path = write_csv(tmp_path / "csv", "2-1-2024,Goa,Panaji,1,O3,40,Good")
    (tmp_path / "csv" / "other.csv").write_text(
        HEADER.replace("state,area", "area,state") + "\n2-1-2024,Panaji,Goa,1,O3,40,Good\n"
    )
    with pytest.raises(Exception, match="(?i)header"):
        clean_readings(spark, path).collect()


def test_line_break_in_quotes(spark, tmp_path):
    path = write_csv(tmp_path / "csv", '2-1-2024,Goa,"Pan\naji",1,O3,40,Good')
    row = clean(read_readings(spark, path, multi_line=True)).first()
    assert row.area == "Pan\naji"


BROKEN = {
    "line break": ('2-1-2024,Goa,Panaji,1,O3,40,Good,"two\nlines"', "2-1-2024,Goa,Panaji,1,O3,50,Poor,x"),
    "surplus field": ("2-1-2024,Goa,Panaji,1,O3,40,Good,x,y",),
    "short record": ("2-1-2024,Goa,Panaji,1,O3,40",),
}
ACTIONS = {
    "count": lambda df: df.count(),
    "group": lambda df: df.groupBy("state").count().collect(),
    "rows": lambda df: df.collect(),
}


@pytest.mark.parametrize("action", ACTIONS)
@pytest.mark.parametrize("case", BROKEN)
def test_malformed_records_raise(spark, tmp_path, case, action):
    path = write_csv(tmp_path / "csv", *BROKEN[case], header=HEADER + ",note")
    for df in (read_readings(spark, path), clean_readings(spark, path)):
        with pytest.raises(Exception, match="multi_line=True"):
            ACTIONS[action](df)


@pytest.mark.parametrize("action, want", [("count", 2), ("group", [("Goa", 2)])])
def test_line_breaks_with_the_option(spark, tmp_path, action, want):
    path = write_csv(tmp_path / "csv", *BROKEN["line break"], header=HEADER + ",note")
    got = ACTIONS[action](clean_readings(spark, path, multi_line=True))
    assert (got if action == "count" else [tuple(r) for r in got]) == want
    assert read_readings(spark, path, mode="PERMISSIVE").count() == 3


def test_overflowing_values_are_missing(spark, tmp_path):
    path = write_csv(tmp_path / "csv", *[f"2-1-2024,Goa,Panaji,1,O3,{v},Good" for v in ("40", "60", "1e999")])
    df = clean_readings(spark, path)
    assert df.count() == 3 and [tuple(r) for r in df.groupBy("state").count().collect()] == [("Goa", 3)]
    assert sorted(r.aqi_value or 0 for r in df.collect()) == [0, 40, 60]
    bins = airq.value_histogram(df, 4).collect()
    assert sum(r.readings for r in bins) == 2 and bins[0].lo == 40
    assert airq.slice_kpis(df).first()[:4] == (3, 50.0, 50.0, 60.0)


@pytest.mark.parametrize("text", ["30-04-2025 00:00:00", "30-4-25", "2025/04/30", "30 Apr 2025", "30/4/2025", "2025-04-30"])
def test_date_forms(spark, text):
    assert apply(spark, parse_day_first, [text, "x"]) == [dt.date(2025, 4, 30), None]


def test_extra_text_column_is_kept_and_stripped(spark, tmp_path):
    path = write_csv(tmp_path / "csv", "2-1-2024,Goa,Panaji,1,O3,40,Good, x ", header=HEADER + ",extra.col")
    assert clean_readings(spark, path).first()["extra.col"] == "x"


def test_required_columns(spark):
    with pytest.raises(ValueError, match="aqi_value"):
        clean(spark.createDataFrame([("a",)], "state string"))


def test_optional_columns(spark):
    df = spark.createDataFrame([("a", "b")], "state string, note string")
    assert drop_optional(df).columns == ["state"]
    assert drop_optional(drop_optional(df)).columns == ["state"]
