"""Sums of doubles that do not depend on how rows are dealt or ordered.

A double is cut into four digits of 20 bits by its exponent. Digits are whole numbers, so
their sums are exact and may be added up in any order, in any number of steps, and kept in
tables. A group has one row of sums per ``level`` of exponents that occurs in
it; all levels together give the total, rounded once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of a value, and bits of a digit. Sums of digits fit a long for 2**42 rows.
DIGITS, BITS = 4, 20
LEVEL = "level"
NAMES = tuple(f"digit_{i}" for i in range(DIGITS))


def with_digits(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``level`` and the digits of ``value``, NULL for a missing value.

    The top digit of level ``t`` counts ``2 ** (20 t)``. What fits level one, as all whole numbers below
    2 ** 40 do, is put there, so that ordinary data has one level. Values must be finite.
    """
    power = "pow(2D, {})".format
    # The least doubles are scaled up, so that no power of two below leaves the range.
    rows = df.selectExpr("*", f"abs({value}) < {power(-500)} AND {value} <> 0D AS _tiny").selectExpr(
        "*", f"abs({value}) * IF(_tiny, {power(600)}, 1D) AS _rest")
    fits = f"NOT _tiny AND _rest < {power(2 * BITS)} AND _rest * {power(2 * BITS)} = floor(_rest * {power(2 * BITS)})"
    rows = rows.selectExpr("*", f"CASE WHEN {fits} THEN 1 WHEN _rest > 0D THEN CAST(floor(log2(_rest) / {BITS}) AS INT) END AS _level")
    for i, name in enumerate(NAMES):
        unit = power(f"{BITS} * (_level - {i})")
        rows = rows.selectExpr("*", f"CAST(floor(_rest / {unit}) AS BIGINT) AS {name}").selectExpr(
            *[f"`{c}`" for c in rows.columns if c != "_rest"], name, f"_rest - {name} * {unit} AS _rest")
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.expr(f"_level - IF(_tiny, {600 // BITS}, 0)").alias(LEVEL),
        *[F.expr(f"IF({value} < 0D, -{name}, {name})").alias(name) for name in NAMES])


def digit_sums() -> list[Column]:
    """Aggregates that add up digits; further sums of these are again sums of digits."""
    return [F.sum(name).alias(name) for name in NAMES]


def totals_of(sums: DataFrame, keys: Sequence[str], also: Sequence[str] = (), name: str = "total") -> DataFrame:
    """``keys``, the sums of the columns ``also``, and the total of each group, from one row per group and level.

    A group has at most some hundred levels. The total is NULL without values.
    """
    grouped = sums.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in also],
        F.collect_list(F.when(F.col(LEVEL).isNotNull(), F.struct(LEVEL, *NAMES))).alias("_levels"))
    kept = [*keys, *also]
    pick = " ".join(f"WHEN s.{LEVEL} - {i} THEN s.{n}" for i, n in enumerate(NAMES))
    base = 1 << BITS
    return (
        # One digit for every place from the lowest to the highest.
        grouped.selectExpr(*kept, "_levels", f"array_min(transform(_levels, s -> s.{LEVEL})) - {DIGITS - 1} AS _low",
                           f"array_max(transform(_levels, s -> s.{LEVEL})) AS _high")
        .selectExpr(*kept, "_low", "IF(_low IS NULL, NULL, transform(sequence(_low, _high), p -> "
                    f"aggregate(_levels, 0L, (a, s) -> a + CASE p {pick} ELSE 0L END))) AS _places")
        .selectExpr(*kept, "_low", f"_places", f"aggregate(_places, 0L, (c, x) -> shiftright(c + x, {BITS})) < 0 AS _negative")
        .selectExpr(*kept, "_low", "_negative", "IF(_negative, transform(_places, x -> -x), _places) AS _places")
        # Carries make the digits those of the exact total, whatever they were sums of.
        .selectExpr(*kept, "_low", "_negative", "aggregate(_places, named_struct('carry', 0L, 'digits', CAST(array() AS ARRAY<BIGINT>)), "
                    f"(a, x) -> named_struct('carry', shiftright(a.carry + x, {BITS}), 'digits', "
                    f"concat(a.digits, array(pmod(a.carry + x, {base}L)))), a -> concat(a.digits, array(a.carry))) AS _exact")
        # From the highest digit down; half powers keep the least places within range.
        .selectExpr(*kept, "IF(_negative, -1D, 1D) * aggregate(reverse(transform(_exact, (x, i) -> "
                    f"CAST(x AS DOUBLE) * pow(2D, {BITS // 2} * (_low + i)) * pow(2D, {BITS // 2} * (_low + i)))), 0D, (a, x) -> a + x) AS {name}")
    )
