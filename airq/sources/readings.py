"""CSV of readings to the cleaned, typed table that all operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from airq.functions.cells import (
    first_listed,
    null_if_missing,
    parse_day_first,
    season_of,
    strip,
    to_count,
    to_number,
)
from airq.schema import (
    DATE,
    DATE_FORMATS,
    MONTH,
    OPTIONAL_COLUMNS,
    POLLUTANT,
    POLLUTANTS,
    RAW_COLUMNS,
    SEASON,
    STATIONS,
    VALUE,
    YEAR,
)


def read_readings(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = False,
    encoding: str = "UTF-8",
    mode: str = "FAILFAST",
) -> DataFrame:
    """Header CSV as text columns, bound by header name.

    No type inference: it would cost a pass of its own, and one dirty cell
    would change the type of a column. ``multi_line`` allows line breaks inside
    quotes, but then a file is read by one task. Every file must carry the same
    header (checked by Spark because the schema is not enforced).

    A record with fewer or more fields than the header raises, whatever columns a
    query uses: lines are parsed whole, and a filter looks at what did not fit.
    ``mode`` may be ``PERMISSIVE`` or ``DROPMALFORMED`` to get Spark's handling.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("multiLine", multi_line)
        .option("encoding", encoding)
        .option("columnPruning", False)
    )
    if mode.upper() != "FAILFAST":
        raw = reader.option("mode", mode).csv(path)
        check_columns(raw)
        return missing_to_null(raw)
    header = reader.csv(path)
    check_columns(header)
    broken = "_broken"
    while broken in header.columns:
        broken += "_"
    schema = StructType([*header.schema.fields, StructField(broken, StringType())])
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).schema(schema).csv(path)
    # Spark wants a column of the file beside the broken record, so the first one is named.
    first = F.coalesce(F.col(f"`{header.columns[0]}`"), F.lit(""))
    complaint = F.concat(
        F.lit("record does not fit the header (line breaks inside quotes need multi_line=True), beginning "),
        first, F.lit(": "), F.col(broken),
    )
    whole = raw.filter(F.when(F.col(broken).isNull(), True).otherwise(F.raise_error(complaint).cast("boolean")))
    return missing_to_null(whole.drop(broken))


def check_columns(raw: DataFrame) -> None:
    """Raise ``ValueError`` when a required column is absent."""
    absent = [c for c in RAW_COLUMNS if c not in raw.columns]
    if absent:
        raise ValueError(f"readings lack the columns {absent}")


def _on_text(df: DataFrame, change) -> DataFrame:
    """Apply ``change`` to every text column in one projection."""
    return df.select(*[
        change(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def missing_to_null(df: DataFrame) -> DataFrame:
    """Missing-value tokens to NULL in every text column."""
    return _on_text(df, null_if_missing)


def drop_optional(df: DataFrame, names: Iterable[str] = OPTIONAL_COLUMNS) -> DataFrame:
    """Drop columns that may or may not be there."""
    return df.drop(*names)


def strip_text(df: DataFrame) -> DataFrame:
    """Strip Unicode whitespace from every text column."""
    return _on_text(df, strip)


def with_year(df: DataFrame) -> DataFrame:
    """Add the year of ``date``."""
    return df.withColumn(YEAR, F.year(DATE))


def with_month(df: DataFrame) -> DataFrame:
    """Add the month of ``date``."""
    return df.withColumn(MONTH, F.month(DATE))


def with_season(df: DataFrame) -> DataFrame:
    """Add the season of ``month``."""
    return df.withColumn(SEASON, season_of(F.col(MONTH)))


def with_primary_pollutant(df: DataFrame) -> DataFrame:
    """Add the first pollutant of the list."""
    return df.withColumn(POLLUTANT, first_listed(F.col(POLLUTANTS)))


def clean(raw: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Typed readings from text readings whose missing cells are NULL already."""
    check_columns(raw)
    text = strip_text(drop_optional(raw))
    typed = text.withColumns({
        DATE: parse_day_first(F.col(DATE), date_formats),
        VALUE: to_number(F.col(VALUE)),
        STATIONS: to_count(F.col(STATIONS)),
    })
    return with_primary_pollutant(with_season(with_month(with_year(typed))))


def clean_readings(
    spark: SparkSession,
    path: str | list[str],
    date_formats: Sequence[str] = DATE_FORMATS,
    multi_line: bool = False,
    encoding: str = "UTF-8",
    mode: str = "FAILFAST",
) -> DataFrame:
    """Read a CSV of readings and clean it; the options are those of ``read_readings``."""
    return clean(read_readings(spark, path, multi_line, encoding, mode), date_formats)
