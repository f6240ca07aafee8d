"""The same queries in SQL, on a cleaned form written without any cleaning.

Types are cast to Spark's: DuckDB widens year() and sum() and its date_trunc
gives a timestamp.
"""

from __future__ import annotations

CLEANED = """
WITH cleaned AS (
  SELECT
    CASE WHEN l_quantity = 7 AND l_tax = 0.0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
    n_name AS state,
    n_name || ' ' || c_mktsegment AS area,
    CAST(l_linenumber AS INTEGER) AS number_of_monitoring_stations,
    CASE WHEN l_quantity = 13 THEN NULL ELSE p_brand || ' , ' || p_type END AS prominent_pollutants,
    CASE WHEN l_quantity = 13 THEN NULL ELSE p_brand END AS primary_pollutant,
    CASE WHEN l_quantity = 1 THEN NULL
         ELSE CAST(floor(l_extendedprice / 200) AS DOUBLE) END AS aqi_value,
    CASE WHEN l_quantity = 50 AND l_discount = 0.0 THEN NULL
         WHEN floor(l_extendedprice / 200) <= 50 THEN 'Good'
         WHEN floor(l_extendedprice / 200) <= 100 THEN 'Satisfactory'
         WHEN floor(l_extendedprice / 200) <= 200 THEN 'Moderate'
         WHEN floor(l_extendedprice / 200) <= 300 THEN 'Poor'
         WHEN floor(l_extendedprice / 200) <= 400 THEN 'Very Poor'
         ELSE 'Severe' END AS air_quality_status
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
), readings AS (
  SELECT *,
    CAST(year(date) AS INTEGER) AS year,
    CAST(month(date) AS INTEGER) AS month,
    CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter'
         WHEN month(date) IN (3, 4, 5) THEN 'Pre-monsoon'
         WHEN month(date) IN (6, 7, 8) THEN 'Monsoon'
         WHEN month(date) IN (9, 10, 11) THEN 'Post-monsoon' END AS season,
    CAST(date_trunc('month', date) AS DATE) AS month_start
  FROM cleaned
)"""

STATUSES = """statuses(status, status_ord) AS (
  VALUES ('Good', 0), ('Satisfactory', 1), ('Moderate', 2),
         ('Poor', 3), ('Very Poor', 4), ('Severe', 5)
)"""

LABELS = """labels(month, label) AS (
  VALUES (1, 'Jan'), (2, 'Feb'), (3, 'Mar'), (4, 'Apr'), (5, 'May'), (6, 'Jun'),
         (7, 'Jul'), (8, 'Aug'), (9, 'Sep'), (10, 'Oct'), (11, 'Nov'), (12, 'Dec')
)"""

SLICE = """slice AS (
  SELECT * FROM readings
  WHERE state IN ('NATION_0', 'NATION_1') AND year IN (1996, 1997, 1998)
    AND primary_pollutant IN ('Brand#2', 'Brand#19')
)"""

ALL_COLUMNS = (
    "date, state, area, number_of_monitoring_stations, prominent_pollutants, aqi_value, "
    "air_quality_status, year, month, season, primary_pollutant"
)

STATUS_COLUMNS = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")


def _sql(select: str, *ctes: str) -> str:
    return ", ".join([CLEANED, *ctes]) + "\n" + select.strip()


def _pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / ({whole}) * 100"


def _count_if(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def _kpis(table: str) -> str:
    good = _count_if("air_quality_status IN ('Good', 'Satisfactory')")
    return f"""
SELECT count(*) AS readings, avg(aqi_value) AS mean_aqi, median(aqi_value) AS median_aqi,
       max(aqi_value) AS max_aqi, {_pct(good, 'count(*)')} AS good_pct
FROM {table}"""


def _histogram(table: str) -> list[str]:
    """Every value is compared with the edges of every bin."""
    return [
        f"""span AS (
  SELECT CASE WHEN low = high THEN low - 0.5 ELSE low END AS low,
         CASE WHEN low = high THEN high + 0.5 ELSE high END AS high
  FROM (SELECT min(aqi_value) AS low, max(aqi_value) AS high FROM {table})
)""",
        """bins AS (
  SELECT CAST(i AS INTEGER) AS bin,
         low + CAST(i - 1 AS DOUBLE) * ((high - low) / 40) AS lo,
         CASE WHEN i = 40 THEN high ELSE low + CAST(i AS DOUBLE) * ((high - low) / 40) END AS hi
  FROM span, generate_series(1, 40) AS g(i)
)""",
        f"""SELECT bin, lo, hi, count(aqi_value) AS readings
FROM bins LEFT JOIN {table}
  ON aqi_value >= lo AND (aqi_value < hi OR (bin = 40 AND aqi_value = hi))
GROUP BY bin, lo, hi ORDER BY bin""",
    ]


def _histogram_sql(table: str, *ctes: str) -> str:
    *own, select = _histogram(table)
    return _sql(select, *ctes, *own)


def _extreme(key: str, direction: str) -> str:
    return f"""
SELECT {key}, avg(aqi_value) AS mean_aqi FROM readings
WHERE {key} IS NOT NULL GROUP BY {key} HAVING avg(aqi_value) IS NOT NULL
ORDER BY mean_aqi {direction}, {key} LIMIT 1"""


def _status_counts(table: str) -> str:
    return f"""
SELECT status, status_ord, count(*) AS readings
FROM statuses JOIN {table} ON air_quality_status = status
GROUP BY status, status_ord ORDER BY status_ord"""


def _monthly(table: str) -> str:
    return f"""
SELECT month_start, avg(aqi_value) AS mean_aqi FROM {table}
WHERE date IS NOT NULL GROUP BY month_start ORDER BY month_start"""


def _wide(key: str, table: str) -> str:
    columns = ", ".join(
        f"""{_pct(_count_if(f"air_quality_status = '{s}'"), 'count(*)')} AS "{s}" """
        for s in STATUS_COLUMNS
    )
    return f"""
SELECT {key}, {columns} FROM {table}
WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(air_quality_status) > 0 ORDER BY {key}"""


def _stack(key: str, table: str) -> list[str]:
    return [
        f"""totals AS (
  SELECT {key}, count(*) AS total FROM {table} WHERE {key} IS NOT NULL
  GROUP BY {key} HAVING count(air_quality_status) > 0
)""",
        f"""shares AS (
  SELECT t.{key}, status, status_ord, {_pct('count(r.air_quality_status)', 'total')} AS pct
  FROM totals t CROSS JOIN statuses
  LEFT JOIN {table} r ON r.{key} = t.{key} AND r.air_quality_status = status
  GROUP BY t.{key}, status, status_ord, total
)""",
        f"""SELECT {key}, status, status_ord,
  coalesce(sum(pct) OVER (PARTITION BY {key} ORDER BY status_ord
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
  sum(pct) OVER (PARTITION BY {key} ORDER BY status_ord
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upper
FROM shares ORDER BY {key}, status_ord""",
    ]


def _stack_sql(key: str, table: str, *ctes: str) -> str:
    *own, select = _stack(key, table)
    return _sql(select, *ctes, STATUSES, *own)


def _annual(years: str) -> list[str]:
    good = _count_if("air_quality_status IN ('Good', 'Satisfactory')")
    poor = _count_if("air_quality_status IN ('Poor', 'Very Poor', 'Severe')")
    return [
        f"wanted AS (SELECT CAST(unnest({years}) AS INTEGER) AS year)",
        """months AS (
  SELECT year, month, row_number() OVER (PARTITION BY year ORDER BY mean DESC, month) AS place
  FROM (SELECT year, month, avg(aqi_value) AS mean FROM readings
        WHERE year IS NOT NULL GROUP BY year, month HAVING avg(aqi_value) IS NOT NULL)
)""",
        f"""figures AS (
  SELECT year, count(*) AS readings, avg(aqi_value) AS mean_aqi,
         median(aqi_value) AS median_aqi, {_pct(good, 'count(*)')} AS good_pct,
         {_pct(poor, 'count(*)')} AS poor_pct
  FROM readings WHERE year IS NOT NULL GROUP BY year
)""",
        """annual AS (
  SELECT w.year, coalesce(f.readings, 0) AS readings, f.mean_aqi, f.median_aqi, f.good_pct,
         f.poor_pct, m.month AS worst_month
  FROM wanted w LEFT JOIN figures f ON f.year = w.year
  LEFT JOIN months m ON m.year = w.year AND m.place = 1
)""",
    ]


AREAS = """areas AS (
  SELECT area, avg(aqi_value) AS mean_aqi, count(aqi_value) AS readings, min(state) AS state
  FROM readings GROUP BY area HAVING count(aqi_value) >= 400
)"""


def _top(n: int) -> str:
    return f"""top AS (
  SELECT primary_pollutant, count(*) AS readings FROM readings
  WHERE primary_pollutant IS NOT NULL GROUP BY primary_pollutant
  ORDER BY readings DESC, primary_pollutant LIMIT {n}
)"""


def _cells(key: str) -> list[str]:
    """Counts per (key, top pollutant), with zero for pairs that do not occur."""
    return [
        f"""held AS (
  SELECT {key}, primary_pollutant, count(*) AS n FROM readings
  WHERE {key} IS NOT NULL AND primary_pollutant IN (SELECT primary_pollutant FROM top)
  GROUP BY {key}, primary_pollutant
)""",
        f"""cells AS (
  SELECT k.{key}, top.primary_pollutant, coalesce(held.n, 0) AS readings
  FROM (SELECT DISTINCT {key} FROM held) k CROSS JOIN top
  LEFT JOIN held ON held.{key} = k.{key} AND held.primary_pollutant = top.primary_pollutant
)""",
    ]


def _share_of(key: str) -> str:
    return _pct("readings", f"sum(readings) OVER (PARTITION BY {key})") + " AS pct"


def _selection(states: str, pollutants: str, state: str) -> str:
    return f"""
SELECT 'states' AS selection, CAST(i - 1 AS INTEGER) AS position, {states}[i] AS value
FROM generate_series(1, 2) AS g(i)
UNION ALL
SELECT 'years', CAST(row_number() OVER (ORDER BY year) - 1 AS INTEGER), CAST(year AS VARCHAR)
FROM (SELECT DISTINCT year FROM readings WHERE year IS NOT NULL)
UNION ALL
SELECT 'pollutants', CAST(i - 1 AS INTEGER), {pollutants}[i] FROM generate_series(1, 2) AS g(i)
UNION ALL
SELECT 'state', 0, {state}"""


def _first_two(column: str) -> str:
    return (
        f"(SELECT list({column} ORDER BY {column}) FROM (SELECT DISTINCT {column} FROM readings "
        f"WHERE {column} IS NOT NULL ORDER BY {column} LIMIT 2))"
    )


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    good = _count_if("air_quality_status IN ('Good', 'Satisfactory')")
    month_columns = ", ".join(
        f"avg(CASE WHEN month = {i} THEN aqi_value END) AS {label}"
        for i, label in enumerate(
            "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), start=1
        )
    )
    labelled = "labelled AS (SELECT * FROM readings WHERE air_quality_status IS NOT NULL)"
    home = "home AS (SELECT * FROM readings WHERE state = 'NATION_0')"
    status_matrix = ", ".join(
        f"""{_count_if(f"air_quality_status = '{s}'")} AS "{s}" """ for s in STATUS_COLUMNS
    )
    return {
        "clean_readings": _sql(f"SELECT {ALL_COLUMNS} FROM readings"),
        "readings_incremental": _sql(f"SELECT {ALL_COLUMNS} FROM readings"),
        "read_readings": _sql(f"SELECT {ALL_COLUMNS} FROM readings"),
        "aqi_band": """
SELECT band, count(*) AS readings, CAST(min(b) AS DOUBLE) AS lowest, CAST(max(b) AS DOUBLE) AS highest
FROM (
  SELECT b, CASE WHEN b <= 50 THEN 'Good' WHEN b <= 100 THEN 'Satisfactory'
                 WHEN b <= 200 THEN 'Moderate' WHEN b <= 300 THEN 'Poor'
                 WHEN b <= 400 THEN 'Very Poor' ELSE 'Severe' END AS band
  FROM (SELECT floor(l_extendedprice / 200) AS b FROM lineitem WHERE l_quantity <> 1)
) GROUP BY band ORDER BY lowest""".strip(),
        "list_states": _sql(
            "SELECT DISTINCT state FROM readings WHERE state IS NOT NULL ORDER BY state"
        ),
        "list_years": _sql(
            "SELECT DISTINCT year FROM readings WHERE year IS NOT NULL ORDER BY year"
        ),
        "list_pollutants": _sql(
            "SELECT DISTINCT primary_pollutant FROM readings "
            "WHERE primary_pollutant IS NOT NULL ORDER BY primary_pollutant"
        ),
        "dataset_profile": _sql("""
SELECT count(*) AS readings, count(DISTINCT state) AS states, count(DISTINCT area) AS areas,
       min(year) AS first_year, max(year) AS last_year FROM readings"""),
        "default_filters": _sql(_selection(
            "['NATION_0', 'NATION_1']", "['Brand#2', 'Brand#19']", "'NATION_0'"
        )),
        "default_filters_fallback": _sql(_selection(
            _first_two("state"), _first_two("primary_pollutant"),
            "(SELECT min(state) FROM readings)",
        )),
        "national_kpis": _sql(f"""
SELECT count(*) AS readings, count(DISTINCT state) AS states, count(DISTINCT area) AS areas,
       avg(aqi_value) AS mean_aqi, {_pct(good, 'count(*)')} AS good_pct FROM readings"""),
        "status_counts": _sql(_status_counts("readings"), STATUSES),
        "status_share_table": _sql(f"""
SELECT status, status_ord, count(air_quality_status) AS readings,
       {_pct('count(air_quality_status)', '(SELECT count(*) FROM readings)')} AS pct
FROM statuses LEFT JOIN readings ON air_quality_status = status
GROUP BY status, status_ord ORDER BY status_ord""", STATUSES),
        "status_pie_share": _sql(f"""
SELECT status, status_ord, {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM statuses JOIN readings ON air_quality_status = status
GROUP BY status, status_ord ORDER BY status_ord""", STATUSES),
        "monthly_mean": _sql(_monthly("readings")),
        "worst_state": _sql(_extreme("state", "DESC")),
        "best_state": _sql(_extreme("state", "ASC")),
        "worst_area": _sql(_extreme("area", "DESC")),
        "severe_share": _sql(
            f"""SELECT {_pct(_count_if("air_quality_status = 'Severe'"), 'count(*)')} AS pct
FROM readings"""
        ),
        "pollutant_share": _sql(
            f"""SELECT {_pct(_count_if("primary_pollutant = 'Brand#2'"), 'count(*)')} AS pct
FROM readings"""
        ),
        "year_month_mean": _sql("""
SELECT year, month, avg(aqi_value) AS mean_aqi FROM readings
WHERE year IN (1996, 1997, 1998) GROUP BY year, month ORDER BY year, month"""),
        "season_mean": _sql("""
SELECT season, avg(aqi_value) AS mean_aqi FROM readings
WHERE season IS NOT NULL GROUP BY season ORDER BY mean_aqi DESC NULLS LAST, season"""),
        "season_status_share": _sql(f"""
SELECT r.season, air_quality_status AS status, count(*) AS readings,
       {_pct('count(*)', 'any_value(total)')} AS pct
FROM readings r JOIN (SELECT season, count(*) AS total FROM readings GROUP BY season) t
  ON t.season = r.season
WHERE air_quality_status IS NOT NULL
GROUP BY r.season, air_quality_status ORDER BY r.season, status"""),
        "season_status_wide": _sql(_wide("season", "readings")),
        "season_status_stack": _stack_sql("season", "readings"),
        "year_month_matrix": _sql(f"""
SELECT year, {month_columns} FROM readings
WHERE year IN (1996, 1997, 1998, 2001) GROUP BY year ORDER BY year"""),
        "month_status_share": _sql(f"""
SELECT r.month_start, air_quality_status AS status, count(*) AS readings,
       {_pct('count(*)', 'any_value(total)')} AS pct
FROM labelled r JOIN (SELECT month_start, count(*) AS total FROM labelled GROUP BY month_start) t
  ON t.month_start = r.month_start
GROUP BY r.month_start, air_quality_status ORDER BY r.month_start, status""", labelled),
        "month_status_wide": _sql(_wide("month_start", "labelled"), labelled),
        "month_status_stack": _stack_sql("month_start", "labelled", labelled),
        "annual_summary": _sql(
            "SELECT * FROM annual ORDER BY year", *_annual("[1996, 1997, 1998, 2022]")
        ),
        "annual_summary_text": _sql("""
SELECT year, format('{:,}', readings) AS readings, format('{:.1f}', mean_aqi) AS mean_aqi,
       format('{:.1f}', median_aqi) AS median_aqi, format('{:.1f}%', good_pct) AS good_pct,
       format('{:.1f}%', poor_pct) AS poor_pct, label AS worst_month
FROM annual JOIN labels ON worst_month = labels.month ORDER BY year""",
            *_annual("[1996, 1997, 1998]"), LABELS),
        "state_ranking": _sql("""
SELECT state, avg(aqi_value) AS mean_aqi, (SELECT avg(aqi_value) FROM readings) AS national_mean
FROM readings WHERE state IS NOT NULL GROUP BY state
ORDER BY mean_aqi DESC NULLS LAST, state"""),
        "area_ranking": _sql("SELECT * FROM areas ORDER BY mean_aqi DESC, area", AREAS),
        "top_areas": _sql("SELECT * FROM areas ORDER BY mean_aqi DESC, area LIMIT 10", AREAS),
        "bottom_areas": _sql("""
SELECT * FROM (SELECT * FROM areas ORDER BY mean_aqi, area DESC LIMIT 10)
ORDER BY mean_aqi, area""", AREAS),
        "state_slice": _sql(f"SELECT {ALL_COLUMNS} FROM readings WHERE state = 'NATION_0'"),
        "state_cards": _sql("""
SELECT avg(aqi_value) AS mean_aqi, count(*) AS readings, count(DISTINCT area) AS areas,
  (SELECT label FROM labels JOIN (
     SELECT month FROM home WHERE month IS NOT NULL GROUP BY month
     ORDER BY avg(aqi_value) DESC NULLS LAST, month LIMIT 1) m ON m.month = labels.month
  ) AS worst_month
FROM home""", home, LABELS),
        "state_month_profile": _sql("""
SELECT labels.month, label, avg(aqi_value) AS mean_aqi
FROM labels LEFT JOIN home ON home.month = labels.month
GROUP BY labels.month, label ORDER BY labels.month""", home, LABELS),
        "state_area_ranking": _sql("""
SELECT area, avg(aqi_value) AS mean_aqi FROM home GROUP BY area
ORDER BY mean_aqi DESC NULLS LAST, area LIMIT 10""", home),
        "state_status_breakdown": _sql(f"""
SELECT status, status_ord, count(*) AS readings,
       {_pct('count(*)', '(SELECT count(*) FROM home)')} AS pct
FROM statuses JOIN home ON air_quality_status = status
GROUP BY status, status_ord ORDER BY status_ord""", home, STATUSES),
        "top_pollutants": _sql("""
SELECT primary_pollutant, readings,
       CAST(row_number() OVER (ORDER BY readings DESC, primary_pollutant) AS INTEGER) AS rank
FROM top ORDER BY rank""", _top(10)),
        "pollutant_mean": _sql("""
SELECT primary_pollutant, avg(aqi_value) AS mean_aqi FROM readings
WHERE primary_pollutant IN (SELECT primary_pollutant FROM top)
GROUP BY primary_pollutant ORDER BY mean_aqi DESC NULLS LAST, primary_pollutant""", _top(10)),
        "pollutant_status_matrix": _sql(f"""
SELECT primary_pollutant, {status_matrix} FROM readings
WHERE primary_pollutant IN (SELECT primary_pollutant FROM top)
  AND air_quality_status IS NOT NULL
GROUP BY primary_pollutant ORDER BY primary_pollutant""", _top(8)),
        "season_pollutant_share": _sql(f"""
SELECT season, primary_pollutant, n AS readings,
       {_pct('n', 'sum(n) OVER (PARTITION BY season)')} AS pct
FROM held ORDER BY season, primary_pollutant""", _top(6), _cells("season")[0]),
        "season_pollutant_grid": _sql(f"""
SELECT season, primary_pollutant, {_share_of('season')}
FROM cells ORDER BY season, primary_pollutant""", _top(6), *_cells("season")),
        "season_pollutant_wide": _sql(
            "SELECT season, " + ", ".join(
                f"max(primary_pollutant) FILTER (place = {i}) AS name_{i}, max(pct) FILTER (place = {i}) AS pct_{i}"
                for i in range(1, 7)
            ) + " FROM placed GROUP BY season ORDER BY season",
            _top(6), *_cells("season"),
            f"grid AS (SELECT season, primary_pollutant, {_share_of('season')} FROM cells)",
            "placed AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY primary_pollutant) AS place FROM grid)",
        ),
        "state_pollutant_counts": _sql(
            "SELECT state, primary_pollutant, readings FROM cells ORDER BY ALL",
            _top(6), *_cells("state"),
        ),
        "state_pollutant_share": _sql(f"""
SELECT state, primary_pollutant, {_share_of('state')}
FROM cells ORDER BY state, primary_pollutant""", _top(6), *_cells("state")),
        "pollutant_facts": _sql("""
SELECT name AS primary_pollutant, count(readings.primary_pollutant) AS readings,
       avg(aqi_value) AS mean_aqi
FROM (VALUES ('Brand#2'), ('Brand#19'), ('Brand#99')) AS names(name)
LEFT JOIN readings ON primary_pollutant = name GROUP BY name"""),
        "filter_readings": _sql(f"SELECT {ALL_COLUMNS} FROM slice", SLICE),
        "filtered_kpis": _sql(_kpis("slice"), SLICE),
        "slice_kpis": _sql(_kpis("readings")),
        "value_histogram": _histogram_sql("readings"),
        "filtered_histogram": _histogram_sql("slice", SLICE),
        "filtered_status_counts": _sql(_status_counts("slice"), SLICE, STATUSES),
        "state_comparison": _sql("""
SELECT state, avg(aqi_value) AS mean_aqi FROM slice GROUP BY state
ORDER BY mean_aqi DESC NULLS LAST, state""", SLICE),
        "filtered_monthly_mean": _sql(_monthly("slice"), SLICE),
        "preview_rows": _sql("""
SELECT date, state, area, primary_pollutant, aqi_value, air_quality_status,
       number_of_monitoring_stations FROM readings
ORDER BY date DESC NULLS LAST, state, area, primary_pollutant NULLS LAST, aqi_value NULLS LAST,
         air_quality_status NULLS LAST, number_of_monitoring_stations LIMIT 500"""),
        "preview_count": _sql("SELECT count(*) AS readings FROM slice", SLICE),
        "clustered_slice": _sql(f"""SELECT {ALL_COLUMNS} FROM readings
WHERE state = 'NATION_0' AND primary_pollutant = 'Brand#2' AND date BETWEEN DATE '1996-03-01' AND DATE '1997-08-31'"""),
        "rejected_cells": """
WITH cells AS (
  SELECT l_linenumber AS stations, l_quantity AS quantity, l_tax AS tax, CAST(floor(l_extendedprice / 200) AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)
SELECT * FROM (
  SELECT 'date' AS column, 'not a date' AS reason, count(*) FILTER (quantity = 7 AND tax = 0.0) AS cells FROM cells
  UNION ALL SELECT 'number_of_monitoring_stations', 'not a whole number', count(*) FILTER (stations = 7) FROM cells
  UNION ALL SELECT 'aqi_value', 'not a number', count(*) FILTER (quantity <> 1 AND value % 100 = 11) FROM cells
  UNION ALL SELECT 'air_quality_status', 'not a known status', count(*) FILTER (quantity <> 1 AND value % 100 = 12) FROM cells
) WHERE cells > 0""",
        "site_counts": _sql("""
SELECT part, label, count(DISTINCT site) AS sites FROM (
  SELECT unnest([struct_pack(part := 'month', label := CAST(month_start AS VARCHAR)),
                 struct_pack(part := 'quarter', label := CAST(CAST(date_trunc('quarter', date) AS DATE) AS VARCHAR)),
                 struct_pack(part := 'all', label := 'all')], recursive := true),
         state || chr(9) || area AS site FROM readings)
WHERE label IS NOT NULL GROUP BY part, label"""),
        "footer_profile": _sql("""
SELECT year, count(*) AS readings, count(aqi_value) AS measured, min(aqi_value) AS lowest, max(aqi_value) AS highest,
       max(number_of_monitoring_stations) AS most_stations
FROM readings GROUP BY year"""),
        "summary_rollup": _sql(" UNION ALL ".join(
            f"""SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS label, count(*) AS readings, avg(aqi_value) AS mean_aqi,
       {_pct('count(*)', '(SELECT count(*) FROM readings)')} AS pct
FROM readings WHERE {key} IS NOT NULL GROUP BY {key}"""
            for part, key in (("month", "month_start"), ("state", "state"), ("status", "air_quality_status")))),
        "reproducible_means": _sql(" UNION ALL ".join(
            f"""SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS label, count(aqi_value) AS measured, avg(aqi_value) AS mean_aqi
FROM readings WHERE {key} IS NOT NULL GROUP BY {key}"""
            for part, key in (("month", "month_start"), ("state", "state"), ("area", "area"), ("pollutant", "primary_pollutant")))),
    }
