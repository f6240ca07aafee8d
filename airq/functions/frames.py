"""DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airq.schema import STATUS_ORDER


def spine(spark: SparkSession, column: str, values: Iterable) -> DataFrame:
    """``position, column``: one row per literal value, in the order given.

    Built from literals so that Spark knows it is tiny when it plans a join.
    """
    array = F.array(*[F.lit(value) for value in values])
    return spark.range(1).select(F.posexplode(array).alias("position", column))


def with_row(df: DataFrame, one_row: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``one_row`` to every row, matched on ``keys``.

    Without keys ``one_row`` has a single row and comes in as a scalar
    subquery, so there is no join at all.
    """
    if keys:
        return df.join(one_row, list(keys))
    row = one_row.select(F.struct("*").alias("row")).scalar()
    return df.select("*", row.alias("_row")).select("*", "_row.*").drop("_row")


def drop_null_key(counted: DataFrame, key: str, count: str) -> DataFrame:
    """Drop the group without a key from aggregated rows.

    The condition also looks at ``count``, so Spark keeps it above the
    aggregation. A plain ``IS NOT NULL`` would sink to the scan, and a query that
    uses the same counts twice, with and without that group, would then scan the
    readings twice instead of reusing one shuffle.
    """
    return counted.filter(F.when(F.col(count) >= 0, F.col(key)).isNotNull())


def status_rows(wide: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per known status from a frame with one column per status.

    ``fields`` holds one SQL text per status with its further columns. A single
    SQL expression replaces some hundred column objects made one by one.
    """
    rows = ", ".join(
        f"struct('{status}' AS status, {i} AS status_ord, {text})"
        for i, (status, text) in enumerate(zip(STATUS_ORDER, fields))
    )
    return wide.selectExpr(*keys, f"inline(array({rows}))")


def status_counts_rows(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``status_rows`` with the count of each status as ``readings``."""
    return status_rows(wide, keys, [f"`{status}` AS readings" for status in STATUS_ORDER])


def shares_of(wide: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Status counts turned into percentages of ``total``."""
    shares = [f"try_divide(`{s}`, {total}) * 100 AS `{s}`" for s in STATUS_ORDER]
    return wide.selectExpr(*keys, *shares)


def stack_of(shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower and upper bound of each status when the shares are stacked."""
    heights = ["0D"]
    for status in STATUS_ORDER:
        heights.append(f"{heights[-1]} + `{status}`")
    bounds = [f"{low} AS lower, {high} AS upper" for low, high in zip(heights, heights[1:])]
    return status_rows(shares, keys, bounds)


def highest_first(mean: str, key: str) -> list[Column]:
    """Sort order: mean descending, nulls last, ties by key."""
    return [F.col(mean).desc_nulls_last(), F.col(key).asc_nulls_last()]


def lowest_first(mean: str, key: str) -> list[Column]:
    """Sort order: mean ascending, nulls last, ties by key."""
    return [F.col(mean).asc_nulls_last(), F.col(key).asc_nulls_last()]
