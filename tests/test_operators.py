"""Every operator against plain Python over the same random rows."""

from __future__ import annotations

import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import tuples

import airq
from airq.schema import (
    GOOD_STATUSES,
    MONTH_LABELS,
    POOR_STATUSES,
    PREVIEW_COLUMNS,
    STATUS_ORDER,
)

YEARS = (2022, 2023, 2024)
SELECTION = (["Delhi", "Kerala"], [2022, 2024], ["PM10", "PM2.5", "O3"])


def close(got, want):
    """Equal, numbers up to the last bits."""
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x is not None and y is not None and x == pytest.approx(y, rel=1e-12), (a, b)
            else:
                assert x == y, (a, b)


def groups(rows, *keys):
    """Rows by key; rows with a null key are in no group."""
    out = defaultdict(list)
    for row in rows:
        key = tuple(key(row) if callable(key) else row[key] for key in keys)
        if None not in key:
            out[key if len(key) > 1 else key[0]].append(row)
    return out


def values(rows):
    return [r["aqi_value"] for r in rows if r["aqi_value"] is not None]


def mean(rows):
    got = values(rows)
    return sum(got) / len(got) if got else None


def share(rows, *statuses):
    return sum(r["air_quality_status"] in statuses for r in rows) / len(rows) * 100


def month_start(row):
    return row["date"].replace(day=1) if row["date"] else None


def status(row):
    return row["air_quality_status"]


def ranked(pairs, reverse=True):
    """(key, mean) pairs by mean, nulls last, ties by key."""
    sign = -1 if reverse else 1
    return sorted(pairs, key=lambda p: (p[1] is None, sign * (p[1] or 0), p[0]))


def means(rows, key):
    return [(k, mean(g)) for k, g in groups(rows, key).items()]


def top(rows, n):
    counts = Counter(r["primary_pollutant"] for r in rows if r["primary_pollutant"] is not None)
    return sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:n]


def worst_month(rows):
    return ranked([p for p in means(rows, "month") if p[1] is not None])[0][0]


def selected(rows):
    states, years, pollutants = SELECTION
    return [r for r in rows if r["state"] in states and r["year"] in years
            and r["primary_pollutant"] in pollutants]


def test_lists(sample, sample_df):
    for name, key in (("states", "state"), ("years", "year"), ("pollutants", "primary_pollutant")):
        want = sorted({r[key] for r in sample if r[key] is not None})
        assert [v for (v,) in tuples(getattr(airq, f"list_{name}")(sample_df))] == want


def test_dataset_profile(sample, sample_df):
    assert tuples(airq.dataset_profile(sample_df)) == [(
        len(sample), len(groups(sample, "state")), len(groups(sample, "area")), 2021, 2024
    )]


def test_default_filters(sample_df):
    got = tuples(airq.default_filters(sample_df))
    years = [("years", i, str(y)) for i, y in enumerate((2021, 2022, 2023, 2024))]
    assert got == [("states", 0, "Delhi"), ("states", 1, "Maharashtra"), *years,
                   ("pollutants", 0, "PM10"), ("pollutants", 1, "PM2.5"), ("state", 0, "Delhi")]
    other = tuples(airq.default_filters(sample_df, ("Nowhere", "Delhi"), ("Nothing", "O3")))
    assert other == [("states", 0, "Assam"), ("states", 1, "Delhi"), *years,
                     ("pollutants", 0, "C6H6"), ("pollutants", 1, "CO"), ("state", 0, "Assam")]


def test_national_kpis(sample, sample_df):
    close(tuples(airq.national_kpis(sample_df)), [(
        len(sample), len(groups(sample, "state")), len(groups(sample, "area")), mean(sample),
        share(sample, *GOOD_STATUSES),
    )])


def test_status_tables(sample, sample_df):
    counts = Counter(map(status, sample))
    known = sum(counts[s] for s in STATUS_ORDER)
    order = list(enumerate(STATUS_ORDER))
    assert tuples(airq.status_counts(sample_df)) == [(s, i, counts[s]) for i, s in order]
    close(tuples(airq.status_share_table(sample_df)),
          [(s, i, counts[s], counts[s] / len(sample) * 100) for i, s in order])
    close(tuples(airq.status_pie_share(sample_df)),
          [(s, i, counts[s] / known * 100) for i, s in order])


def test_monthly_mean(sample, sample_df):
    close(tuples(airq.monthly_mean(sample_df)), sorted(means(sample, month_start)))


def test_extremes(sample, sample_df):
    states, areas = means(sample, "state"), means(sample, "area")
    close(tuples(airq.worst_state(sample_df)), ranked(states)[:1])
    close(tuples(airq.best_state(sample_df)), ranked(states, reverse=False)[:1])
    close(tuples(airq.worst_area(sample_df)), ranked(areas)[:1])


def test_shares(sample, sample_df):
    close(tuples(airq.severe_share(sample_df)), [(share(sample, "Severe"),)])
    pm10 = sum(r["primary_pollutant"] == "PM10" for r in sample) / len(sample) * 100
    close(tuples(airq.pollutant_share(sample_df)), [(pm10,)])


def test_year_month(sample, sample_df):
    cells = {k: mean(g) for k, g in groups(sample, "year", "month").items()}
    close(tuples(airq.year_month_mean(sample_df)),
          sorted((y, m, v) for (y, m), v in cells.items() if y in YEARS))
    matrix = airq.year_month_matrix(sample_df)
    assert matrix.columns == ["year", *MONTH_LABELS]
    close(tuples(matrix), [(y, *[cells.get((y, m)) for m in range(1, 13)]) for y in YEARS])


def test_season_mean(sample, sample_df):
    close(tuples(airq.season_mean(sample_df)), ranked(means(sample, "season")))


@pytest.mark.parametrize("name, key, labelled_only", [
    ("season_status", "season", False), ("month_status", month_start, True),
])
def test_status_mix(sample, sample_df, name, key, labelled_only):
    rows = [r for r in sample if status(r) is not None] if labelled_only else sample
    total = {k: len(g) for k, g in groups(rows, key).items()}
    cells = {k: len(g) for k, g in groups(rows, key, status).items()}
    close(tuples(getattr(airq, f"{name}_share")(sample_df)),
          sorted((k, s, n, n / total[k] * 100) for (k, s), n in cells.items()))
    wide = [(k, *[cells.get((k, s), 0) / total[k] * 100 for s in STATUS_ORDER])
            for k in sorted(total)]
    close(tuples(getattr(airq, f"{name}_wide")(sample_df)), wide)
    stack = [(k, s, i, sum(shares[:i], 0.0), sum(shares[:i + 1], 0.0))
             for k, *shares in wide for i, s in enumerate(STATUS_ORDER)]
    close(tuples(getattr(airq, f"{name}_stack")(sample_df)), stack)


def test_annual_summary(sample, sample_df):
    want = []
    for year in (2024, 2022, 2023):
        rows = [r for r in sample if r["year"] == year]
        want.append((year, len(rows), mean(rows), statistics.median(values(rows)),
                     share(rows, *GOOD_STATUSES), share(rows, *POOR_STATUSES), worst_month(rows)))
    close(tuples(airq.annual_summary(sample_df, (2024, 2022, 2023))), want)
    text = [(y, f"{n:,}", f"{a:.1f}", f"{b:.1f}", f"{c:.1f}%", f"{d:.1f}%", MONTH_LABELS[m - 1])
            for y, n, a, b, c, d, m in want]
    assert tuples(airq.annual_summary_text(sample_df, (2024, 2022, 2023))) == text


def test_state_ranking(sample, sample_df):
    close(tuples(airq.state_ranking(sample_df)),
          [(*pair, mean(sample)) for pair in ranked(means(sample, "state"))])


def test_area_rankings(sample, sample_df):
    table = []
    for area, rows in groups(sample, "area").items():
        states = [r["state"] for r in rows if r["state"] is not None]
        if len(values(rows)) >= 25:
            table.append((area, mean(rows), len(values(rows)), min(states, default=None)))
    table.sort(key=lambda r: (-r[1], r[0]))
    assert 4 < len(table) < len(groups(sample, "area"))
    close(tuples(airq.area_ranking(sample_df, 25)), table)
    close(tuples(airq.top_areas(sample_df, 3, 25)), table[:3])
    close(tuples(airq.bottom_areas(sample_df, 3, 25)), table[-3:][::-1])


def test_one_state(sample, sample_df):
    rows = [r for r in sample if r["state"] == "Kerala"]
    assert airq.state_slice(sample_df, "Kerala").count() == len(rows)
    close(tuples(airq.state_cards(sample_df, "Kerala")), [(
        mean(rows), len(rows), len(groups(rows, "area")), MONTH_LABELS[worst_month(rows) - 1]
    )])
    months = dict(means(rows, "month"))
    close(tuples(airq.state_month_profile(sample_df, "Kerala")),
          [(m, MONTH_LABELS[m - 1], months.get(m)) for m in range(1, 13)])
    close(tuples(airq.state_area_ranking(sample_df, "Kerala", 2)), ranked(means(rows, "area"))[:2])
    counts = Counter(map(status, rows))
    close(tuples(airq.state_status_breakdown(sample_df, "Kerala")),
          [(s, i, counts[s], counts[s] / len(rows) * 100)
           for i, s in enumerate(STATUS_ORDER) if counts[s]])


def test_pollutant_rankings(sample, sample_df):
    best = top(sample, 7)
    assert tuples(airq.top_pollutants(sample_df, 7)) == [
        (p, n, i + 1) for i, (p, n) in enumerate(best)
    ]
    names = [p for p, _ in best]
    close(tuples(airq.pollutant_mean(sample_df, 7)),
          ranked([p for p in means(sample, "primary_pollutant") if p[0] in names]))
    cells = {k: len(g) for k, g in groups(sample, "primary_pollutant", status).items()}
    matrix = airq.pollutant_status_matrix(sample_df, 7)
    assert matrix.columns == ["primary_pollutant", *STATUS_ORDER]
    assert tuples(matrix) == [
        (p, *[cells.get((p, s), 0) for s in STATUS_ORDER]) for p in sorted(names)
    ]


def test_pollutants_by_season_and_state(sample, sample_df):
    names = sorted(p for p, _ in top(sample, 6))
    rows = [r for r in sample if r["primary_pollutant"] in names]
    seasons = groups(rows, "season")
    cells = {k: len(g) for k, g in groups(rows, "season", "primary_pollutant").items()}
    close(tuples(airq.season_pollutant_share(sample_df)),
          sorted((s, p, n, n / len(seasons[s]) * 100) for (s, p), n in cells.items()))
    grid = [(s, p, cells.get((s, p), 0) / len(seasons[s]) * 100)
            for s in sorted(seasons) for p in names]
    close(tuples(airq.season_pollutant_grid(sample_df)), grid)
    wide = airq.season_pollutant_wide(sample_df)
    assert wide.columns == ["season", *[f"{c}_{i}" for i in range(1, 7) for c in ("name", "pct")]]
    close(tuples(wide), [
        (s, *[cell for season, p, pct in grid if season == s for cell in (p, pct)]) for s in sorted(seasons)
    ])
    assert tuples(airq.season_pollutant_wide(sample_df, 20))[0][-2:] == (None, None)

    states = groups(rows, "state")
    cells = {k: len(g) for k, g in groups(rows, "state", "primary_pollutant").items()}
    counts = [(s, p, cells.get((s, p), 0)) for s in sorted(states) for p in names]
    assert tuples(airq.state_pollutant_counts(sample_df)) == counts
    close(tuples(airq.state_pollutant_share(sample_df)),
          [(s, p, n / len(states[s]) * 100) for s, p, n in counts])


def test_pollutant_facts(sample, sample_df):
    by = groups(sample, "primary_pollutant")
    names = ("O3", "PM10", "Xe")
    close(tuples(airq.pollutant_facts(sample_df, names)),
          [(n, len(by.get(n, [])), mean(by.get(n, []))) for n in names])


def test_selection(sample, sample_df):
    rows = selected(sample)
    assert len(rows) > 50
    assert airq.filter_readings(sample_df, *SELECTION).count() == len(rows)
    good = share(rows, *GOOD_STATUSES)
    close(tuples(airq.filtered_kpis(sample_df, *SELECTION)), [
        (len(rows), mean(rows), statistics.median(values(rows)), max(values(rows)), good)
    ])
    counts = Counter(map(status, rows))
    assert tuples(airq.filtered_status_counts(sample_df, *SELECTION)) == [
        (s, i, counts[s]) for i, s in enumerate(STATUS_ORDER) if counts[s]
    ]
    close(tuples(airq.state_comparison(sample_df, *SELECTION)), ranked(means(rows, "state")))
    close(tuples(airq.filtered_monthly_mean(sample_df, *SELECTION)),
          sorted(means(rows, month_start)))
    assert tuples(airq.preview_count(airq.filter_readings(sample_df, *SELECTION))) == [(len(rows),)]
    edges, heights = histogram(values(rows), 40)
    close(tuples(airq.filtered_histogram(sample_df, *SELECTION)), bars(edges, heights))


def histogram(numbers, bins):
    heights, edges = np.histogram(numbers, bins)
    return [float(e) for e in edges], [int(h) for h in heights]


def bars(edges, heights):
    return [(i + 1, edges[i], edges[i + 1], n) for i, n in enumerate(heights)]


@pytest.mark.parametrize("numbers", [
    [5.0, 5.0],
    [0.1 * i for i in range(400)],
    [0.7, 0.1, 0.3, 0.2, 0.6, 0.1 + 0.2],
    [-3.0, -2.9, 8.05, 100.0],
    [i / 7 for i in range(-200, 300)],
    [1e-9 * i for i in range(81)],
    [0.0],
])
@pytest.mark.parametrize("bins", [1, 7, 40])
def test_histogram_bins_like_numpy(frame, numbers, bins):
    from conftest import reading

    df = frame([reading(value=v) for v in numbers] + [reading()])
    got = tuples(airq.value_histogram(df, bins))
    edges, heights = histogram(numbers, bins)
    assert [row[3] for row in got] == heights
    close(got, bars(edges, heights))


def test_preview(sample, sample_df):
    def key(row):
        newest = -row["date"].toordinal() if row["date"] else 0
        return newest, *[(row[c] is None, "" if row[c] is None else row[c])
                         for c in PREVIEW_COLUMNS if c != "date"]

    want = [tuple(r[c] for c in PREVIEW_COLUMNS) for r in sorted(sample, key=key)]
    assert tuples(airq.preview_rows(sample_df, 300)) == want[:300]
    assert tuples(airq.preview_rows(sample_df, 10**6)) == want


def test_slice_kpis_of_everything(sample, sample_df):
    close(tuples(airq.slice_kpis(sample_df)), [(
        len(sample), mean(sample), statistics.median(values(sample)), max(values(sample)),
        share(sample, *GOOD_STATUSES),
    )])
