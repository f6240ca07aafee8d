"""Exact median by radix selection, which never holds a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Low bits that the first and the second round leave open: 2**22 buckets at most, then 2**21.
FIRST, SECOND = 42, 21


def ordered_bits(table: str, value: str, columns: str) -> str:
    """SQL: ``columns`` of ``table`` and ``code``, the bits of a double as a long in the order of the doubles.

    Minus zero counts as zero. The exponent comes from a logarithm, which may be off by one next to a power of
    two; powers of two and what is multiplied by them are exact.
    """
    return f"""
SELECT {columns}, CASE WHEN {value} = 0D THEN 0L ELSE IF({value} < 0D, -1L, 1L) * CASE
    -- Doubles under the least normal one all have exponent field 0.
    WHEN size < pow(2D, -1022) THEN CAST(size * pow(2D, 537) * pow(2D, 537) AS BIGINT)
    ELSE (power + 1023) * {1 << 52}L + CAST((size / pow(2D, power) - 1D) * {1 << 52}D AS BIGINT) END END AS code
FROM (SELECT *, guess + CASE WHEN size < pow(2D, guess) THEN -1
                             WHEN guess < 1023 AND size >= pow(2D, guess + 1) THEN 1 ELSE 0 END AS power
      FROM (SELECT *, abs({value}) AS size, CAST(floor(log2(abs({value}))) AS INT) AS guess FROM {table}))"""


def median_of_counts(
    counts: DataFrame, value: str, n: str, keys: Sequence[str] = (), name: str = "median"
) -> DataFrame:
    """Exact, interpolated median per key from ``keys, value, n``.

    ``counts`` has one row per distinct value with the number of times it
    occurs, so readings are combined on the map side before any shuffle. Values are dealt by
    their leading bits; running totals over the buckets show which one or two hold
    the middle ranks. Those are dealt by the next bits, and only what is left then is put
    in order: at most 2**22 rows per key in each step, however many values there are and wherever they
    lie. ``percentile`` would keep all distinct values of a key in one task's memory
    instead.

    Values must be finite. Without keys the result is one row, NULL when
    nothing was counted.
    """
    own = "".join(f"{k}, " for k in keys)
    partition = f"PARTITION BY {own[:-2]}" if keys else ""
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    grouped = f"GROUP BY {own[:-2]}" if keys else ""
    # A row that ends at rank ``r`` holds the lower or the upper middle rank.
    middle = "{r} - {n} < total div 2 + 1 AND {r} >= (total + 1) div 2"

    def ends(rows: str, bits: int, total: str, before: str, carried: str) -> str:
        """First and last bucket with a middle rank, and what comes before them."""
        return f"""
SELECT {own} total, min(bucket) AS first_bucket, max(bucket) AS last_bucket, min(reached - held) AS before
FROM (SELECT {own} bucket, held, {total} AS total, {before} + sum(held) OVER ({partition} ORDER BY bucket {running}) AS reached
      FROM (SELECT {own} {carried} shiftright(code, {bits}) AS bucket, sum({n}) AS held FROM {rows}
            GROUP BY {own} {carried} shiftright(code, {bits})))
WHERE {middle.format(r="reached", n="held")} GROUP BY {own} total"""

    def inside(rows: str, buckets: str, bits: int) -> str:
        columns = f"{own} {value}, {n}, code"
        if keys:
            joined = f"(SELECT {columns} FROM {rows}) JOIN {buckets} USING ({own[:-2]})"
            return f"SELECT {columns}, total, before FROM {joined} WHERE shiftright(code, {bits}) BETWEEN first_bucket AND last_bucket"
        return f"""
SELECT {columns}, ends.total, ends.before
FROM (SELECT {columns}, (SELECT struct(*) FROM {buckets}) AS ends FROM {rows})
WHERE shiftright(code, {bits}) BETWEEN ends.first_bucket AND ends.last_bucket"""

    # The count is looked at so that this stays above the aggregation: on the value
    # alone it would sink to a scan of its own.
    counted = f"(SELECT {own} IF({n} >= 0, {value}, NULL) AS {value}, {n} FROM {{counts}})"
    return counts.sparkSession.sql(f"""
WITH coded AS ({ordered_bits(counted, value, f"{own} {value}, {n}")}),
first_ends AS ({ends("coded", FIRST, f"sum(held) OVER ({partition})", "0L", "")}),
first AS ({inside("coded", "first_ends", FIRST)}),
second_ends AS ({ends("first", SECOND, "total", "before", "total, before, ")}),
second AS ({inside("first", "second_ends", SECOND)})
SELECT {own} (min({value}) + max({value})) / 2 AS {name}
FROM (SELECT {own} {value}, {n}, total, before + sum({n}) OVER ({partition} ORDER BY code {running}) AS rank FROM second)
WHERE {middle.format(r="rank", n=n)} {grouped}""", counts=counts)
