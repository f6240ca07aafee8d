"""Shared session, a small random table and helpers."""

from __future__ import annotations

import datetime as dt
import random
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))

from airq.schema import CLEAN_SCHEMA, SEASON_MONTHS, STATUS_ORDER  # noqa: E402
from airq.session import local_session  # noqa: E402

COLUMNS = [field.split()[0] for field in CLEAN_SCHEMA.split(", ")]


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    yield session
    session.stop()


def season(month):
    if month is None:
        return None
    return next(s for s, months in SEASON_MONTHS.items() if month in months)


def reading(date=None, state=None, area=None, value=None, status=None, pollutant=None, stations=1):
    """One cleaned row as a dict."""
    month = date.month if date else None
    return {
        "date": date, "state": state, "area": area, "number_of_monitoring_stations": stations,
        "prominent_pollutants": None if pollutant is None else pollutant + ",XX",
        "aqi_value": None if value is None else float(value), "air_quality_status": status,
        "year": date.year if date else None, "month": month, "season": season(month),
        "primary_pollutant": pollutant,
    }


def random_readings(n=1500, seed=11):
    """Random rows: a third in one state, nulls in every column, unknown labels."""
    rng = random.Random(seed)
    states = ["Delhi", "Maharashtra", "Kerala", "Punjab", "Goa", "Assam"]
    pollutants = ["PM10", "PM2.5", "O3", "CO", "NO2", "SO2", "NH3", "Pb", "C6H6"]
    statuses = [*STATUS_ORDER, "Hazardous", None]
    rows = []
    for i in range(n):
        state = "Delhi" if i % 3 == 0 else rng.choice([*states, None])
        area = rng.choice([f"{state} A", f"{state} B", "Shared", None])
        date = dt.date(rng.choice([2021, 2022, 2023, 2024]), rng.randint(1, 12), rng.randint(1, 28))
        if date.year == 2024 and date.month == 12:
            date = None
        rows.append(reading(
            date if rng.random() > 0.05 else None, state, area,
            None if rng.random() < 0.1 else rng.choice([rng.randint(4, 520), 100]),
            rng.choice(statuses),
            rng.choices([*pollutants, None], weights=[30, 20, 9, 8, 7, 6, 5, 4, 3, 8])[0],
            rng.randint(1, 9),
        ))
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a DataFrame of cleaned readings from row dicts."""
    return lambda rows: spark.createDataFrame(
        [tuple(row[c] for c in COLUMNS) for row in rows], CLEAN_SCHEMA
    )


@pytest.fixture(scope="session")
def sample():
    return random_readings()


@pytest.fixture(scope="session")
def sample_df(frame, sample):
    return frame(sample).cache()


def tuples(df):
    """Result rows as plain tuples, in the order returned."""
    return [tuple(row) for row in df.collect()]
