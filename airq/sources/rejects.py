"""What cleaning throws away: counters of the same pass, and a table of rejected cells and records.

A cell is rejected when it is not missing and has no typed value; a record, when it does not
fit the header. One pass over the files writes rows with what was rejected in them
and counts; readings and rejects are both read from what it wrote.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from airq.schema import DATE, STATIONS, STATUS, STATUS_ORDER, VALUE
from airq.sources.readings import check_columns, clean, missing_to_null, strip_text

#: Reasons by column, as they are counted.
REASONS = {DATE: "not a date", VALUE: "not a number", STATIONS: "not a whole number", STATUS: "not a known status"}
RECORD, RECORD_REASON = "record", "does not fit the header"
_REJECTS, _FILE, _BROKEN = "_rejects", "_file", "_broken"


class Intake(NamedTuple):
    """Readings, rejects, and the counters of the pass."""

    readings: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def _tagged(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cleaned rows with their file, their record if it is broken, and their rejected cells."""
    reader = (
        spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("columnPruning", False))
    header = reader.csv(path)
    check_columns(header)
    schema = StructType([*header.schema.fields, StructField(_BROKEN, StringType())])
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).schema(schema).csv(path)
    held = raw.select("*", F.input_file_name().alias(_FILE), F.struct(*REASONS).alias("_cells"))
    # Cleaning changes text columns only; the cells as they were read ride along in a struct.
    rows = clean(missing_to_null(held.withColumn(_BROKEN, F.struct(_BROKEN))))
    cells = strip_text(missing_to_null(rows.select("*", *[F.col(f"_cells.{c}").alias(f"_cell_{c}") for c in REASONS])))
    bad = []
    for column, reason in REASONS.items():
        cell = F.col(f"_cell_{column}")
        lost = F.col(column).isNull() if column != STATUS else ~F.col(STATUS).isin(*STATUS_ORDER)
        bad.append(F.when(cell.isNotNull() & lost, _reject(column, F.col(f"_cells.{column}"), reason)))
    record = F.col(f"{_BROKEN}.{_BROKEN}")
    rejects = F.when(record.isNotNull(), F.array(_reject(RECORD, record, RECORD_REASON))).otherwise(
        F.array_compact(F.array(*bad)))
    kept = [c for c in rows.columns if c not in ("_cells", _BROKEN)]
    return cells.select(*kept, rejects.alias(_REJECTS))


def _reject(column: str, cell: Column, reason: str) -> Column:
    return F.struct(F.lit(column).alias("column"), cell.alias("cell"), F.lit(reason).alias("reason"))


def _broken_record() -> Column:
    return F.exists(_REJECTS, lambda r: r["column"] == RECORD)


def take_in(spark: SparkSession, path: str | list[str], folder: str) -> Intake:
    """Clean the CSV files at ``path`` into ``folder`` and keep what was rejected.

    ``readings`` are those of ``clean_readings`` without broken records (which raise there). ``rejects`` has
    ``file, column, cell, reason`` per rejected cell, the cell as it was read; a broken record is one
    reject of the column ``record`` with its text. ``counts`` has the rows, the records left out and the cells
    per column, observed while the rows were written; nothing is scanned for them. A status that
    is not known is counted and stays in its reading.
    """
    seen = Observation("intake")
    rows = _tagged(spark, path)
    counters = [F.count(F.lit(1)).alias("rows")] + [
        F.expr(f"sum(size(filter({_REJECTS}, r -> r.column = '{c}'))) AS {c}") for c in (RECORD, *REASONS)]
    rows.observe(seen, *counters).write.parquet(folder)
    counts = {k: v or 0 for k, v in seen.get.items()}
    stored = spark.read.schema(rows.schema).parquet(folder)
    readings = stored.filter(~_broken_record()).drop(_REJECTS, _FILE)
    rejects = stored.filter(F.size(_REJECTS) > 0).select(F.col(_FILE).alias("file"), F.explode(_REJECTS).alias("reject"))
    return Intake(readings, rejects.select("file", "reject.*"), counts)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """``column, reason, cells`` of a table of rejects."""
    return rejects.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("cells"))
