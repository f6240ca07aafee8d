"""Column names and fixed domains of the readings table."""

from __future__ import annotations

DATE = "date"
STATE = "state"
AREA = "area"
VALUE = "aqi_value"
STATUS = "air_quality_status"
POLLUTANTS = "prominent_pollutants"
STATIONS = "number_of_monitoring_stations"
YEAR = "year"
MONTH = "month"
SEASON = "season"
POLLUTANT = "primary_pollutant"

RAW_COLUMNS = (DATE, STATE, AREA, STATIONS, POLLUTANTS, VALUE, STATUS)
OPTIONAL_COLUMNS = ("note", "unit")
PREVIEW_COLUMNS = (DATE, STATE, AREA, POLLUTANT, VALUE, STATUS, STATIONS)

CLEAN_SCHEMA = (
    "date DATE, state STRING, area STRING, number_of_monitoring_stations INT, "
    "prominent_pollutants STRING, aqi_value DOUBLE, air_quality_status STRING, "
    "year INT, month INT, season STRING, primary_pollutant STRING"
)

# Labels, limits and defaults that decide what the results are.
STATUS_ORDER = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")
STATUS_UPPER_LIMITS = (50, 100, 200, 300, 400)
GOOD_STATUSES = ("Good", "Satisfactory")
POOR_STATUSES = ("Poor", "Very Poor", "Severe")
WORST_STATUS = "Severe"
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Pre-monsoon": (3, 4, 5),
    "Monsoon": (6, 7, 8),
    "Post-monsoon": (9, 10, 11),
}
MONTH_LABELS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
COMPARED_YEARS = (2022, 2023, 2024)
DEFAULT_STATES = ("Delhi", "Maharashtra")
DEFAULT_POLLUTANTS = ("PM10", "PM2.5")
FACT_POLLUTANTS = ("PM10", "O3", "CO")

# Cells that mean "missing" in a CSV, compared before stripping.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Every character that Python's str.strip() removes.
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Forms that fill a column of dates, day first; tried in this order, the first that fits counts.
DATE_FORMATS = (
    "d-M-yyyy", "d/M/yyyy", "yyyy-MM-dd", "d-M-yyyy H:mm:ss", "yyyy-MM-dd H:mm:ss",
    "d-M-yy", "d/M/yy", "yyyy/M/d", "d MMM yyyy",
)
