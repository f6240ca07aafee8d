"""Ties, gaps, empty input and unknown labels."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import reading, tuples

import airq
from airq.plans.registry import OPERATORS
from airq.schema import STATUS_ORDER

JAN, FEB = dt.date(2023, 1, 5), dt.date(2023, 2, 5)
TIE = [
    reading(JAN, "B", "b1", 10, "Good", "X"), reading(FEB, "A", "a1", 10, "Good", "Y"),
    reading(JAN, "C", "c1", None, "Poor", "Z"), reading(JAN, None, None, 10, None, None),
]


def test_ties_go_to_the_smaller_key(frame):
    df = frame(TIE)
    assert tuples(airq.worst_state(df)) == [("A", 10.0)]
    assert tuples(airq.best_state(df)) == [("A", 10.0)]
    assert tuples(airq.worst_area(df)) == [("a1", 10.0)]
    assert [r[0] for r in tuples(airq.state_ranking(df))] == ["A", "B", "C"]
    assert tuples(airq.top_pollutants(df, 2)) == [("X", 1, 1), ("Y", 1, 2)]
    assert tuples(airq.annual_summary(df, [2023]))[0][-1] == 1


def test_groups_without_values_rank_last_and_never_win(frame):
    df = frame(TIE)
    assert tuples(airq.state_ranking(df))[-1] == ("C", None, 10.0)
    only_null = frame([reading(JAN, "C", "c", None)])
    assert tuples(airq.worst_state(only_null)) == []
    assert tuples(airq.season_mean(only_null)) == [("Winter", None)]


def test_tied_areas_keep_top_and_bottom_apart(frame):
    rows = [reading(JAN, "S", f"a{i:02}", 7) for i in range(25) for _ in range(2)]
    df = frame(rows)
    assert [r[0] for r in tuples(airq.top_areas(df, 10, 2))] == [f"a{i:02}" for i in range(10)]
    assert [r[0] for r in tuples(airq.bottom_areas(df, 10, 2))] == [f"a{i:02}" for i in range(15, 25)]


def test_equal_area_names_merge(frame):
    df = frame([reading(JAN, "B", "same", 10), reading(JAN, "A", "same", 20)])
    assert tuples(airq.area_ranking(df, 1)) == [("same", 15.0, 2, "A")]


def test_a_missing_status_counts_in_the_total_only(frame):
    df = frame([reading(JAN, "A", "a", 1, s) for s in ("Good", None, "Hazardous", "Severe")])
    assert tuples(airq.national_kpis(df))[0][-1] == 25.0
    assert tuples(airq.severe_share(df)) == [(25.0,)]
    assert [r[3] for r in tuples(airq.status_share_table(df))] == [25.0, 0, 0, 0, 0, 25.0]
    assert [r[2] for r in tuples(airq.status_pie_share(df))] == [50.0, 50.0]
    assert tuples(airq.season_status_share(df)) == [
        ("Winter", "Good", 1, 25.0), ("Winter", "Hazardous", 1, 25.0), ("Winter", "Severe", 1, 25.0)
    ]
    third = 1 / 3 * 100
    assert tuples(airq.month_status_share(df)) == [
        (JAN.replace(day=1), s, 1, third) for s in ("Good", "Hazardous", "Severe")
    ]
    assert tuples(airq.season_status_wide(df)) == [("Winter", 25.0, 0.0, 0.0, 0.0, 0.0, 25.0)]


def test_a_season_with_null_statuses_only_has_no_row(frame):
    df = frame([reading(JAN, "A", "a", 1, None), reading(dt.date(2023, 7, 1), "A", "a", 1, "Odd")])
    assert tuples(airq.season_status_wide(df)) == [("Monsoon", *[0.0] * 6)]
    assert tuples(airq.month_status_wide(df)) == [(dt.date(2023, 7, 1), *[0.0] * 6)]
    assert len(tuples(airq.season_status_stack(df))) == 6


def test_absent_statuses_are_left_out_of_counts_but_not_of_the_table(frame):
    df = frame([reading(JAN, "A", "a", 1, "Poor")])
    assert tuples(airq.status_counts(df)) == [("Poor", 3, 1)]
    assert tuples(airq.status_pie_share(df)) == [("Poor", 3, 100.0)]
    assert [r[2] for r in tuples(airq.status_share_table(df))] == [0, 0, 0, 1, 0, 0]


def test_a_top_pollutant_without_statuses_has_no_matrix_row(frame):
    df = frame([reading(JAN, "A", "a", 1, None, "PM10")] * 3 + [reading(JAN, "A", "a", 1, "Good", "O3")])
    assert tuples(airq.pollutant_status_matrix(df, 2)) == [("O3", 1, 0, 0, 0, 0, 0)]


def test_ranking_pollutants_counts_rows_without_season_or_state(frame):
    rows = [reading(None, None, "a", 1, "Good", "PM10")] * 5
    rows += [reading(JAN, "A", "a", 1, "Good", "O3")] * 3 + [reading(FEB, "B", "b", 1, "Good", "CO")]
    df = frame(rows)
    assert tuples(airq.season_pollutant_share(df, 2)) == [("Winter", "O3", 3, 100.0)]
    assert tuples(airq.season_pollutant_grid(df, 2)) == [("Winter", "O3", 100.0), ("Winter", "PM10", 0.0)]
    assert tuples(airq.state_pollutant_counts(df, 2)) == [("A", "O3", 3), ("A", "PM10", 0)]


def test_years_without_rows(frame):
    assert tuples(airq.annual_summary(frame(TIE), [1999, 2023]))[0] == (1999, 0, *[None] * 5)
    text = tuples(airq.annual_summary_text(frame(TIE), [1999]))
    assert text == [(1999, "0", *[None] * 5)]


def test_large_numbers_as_text(frame):
    df = frame([reading(JAN, "A", "a", v) for v in (0.25, 4000.25)] + [reading(JAN)] * 1234)
    row = tuples(airq.annual_summary_text(df, [2023]))[0]
    assert row[1:4] == ("1,236", f"{2000.25:.1f}", f"{2000.25:.1f}")


def test_one_selected_state_is_not_compared(frame):
    df = frame(TIE)
    assert tuples(airq.state_comparison(df, ["A"], [2023], ["Y"])) == []
    assert tuples(airq.state_comparison(df, ["A", "Q"], [2023], ["Y"])) == [("A", 10.0)]


@pytest.mark.parametrize("hole", range(3))
def test_empty_lists_are_refused(frame, hole):
    lists = [["A"], [2023], ["Y"]]
    lists[hole] = []
    with pytest.raises(ValueError, match="select at least one"):
        airq.filtered_kpis(frame(TIE), *lists)


def test_is_empty(frame):
    df = frame(TIE)
    assert airq.is_empty(airq.filter_readings(df, ["A"], [2023], ["nope"]))
    assert not airq.is_empty(df)


def test_unknown_state(frame):
    df = frame(TIE)
    assert tuples(airq.state_cards(df, "Q")) == [(None, 0, 0, None)]
    assert tuples(airq.state_status_breakdown(df, "Q")) == []
    assert [r[2] for r in tuples(airq.state_month_profile(df, "Q"))] == [None] * 12


ROWS_ON_NO_INPUT = {
    "dataset_profile": 1, "national_kpis": 1, "severe_share": 1, "pollutant_share": 1,
    "state_cards": 1, "filtered_kpis": 1, "slice_kpis": 1, "preview_count": 1,
    "status_share_table": len(STATUS_ORDER), "state_month_profile": 12, "pollutant_facts": 3,
    "annual_summary": 4, "annual_summary_text": 3,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_readings_at_all(frame, name):
    assert len(tuples(OPERATORS[name](frame([])))) == ROWS_ON_NO_INPUT.get(name, 0)
