"""Readings derived from the star-schema test tables (see FIXTURES.md).

One reading per line item. Line items and orders, the two largest tables, meet
in a merge join, where adaptive execution splits the partition of a hot key; the
hint only keeps Spark from broadcasting a small sample of the line items. The
other joins are lookups without hints: Spark broadcasts a side when its size is
below the session's limit and otherwise joins it the same way.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airq.functions.cells import aqi_band
from airq.sources.readings import clean, missing_to_null, read_readings
from airq.sources.rejects import Intake, take_in
from airq.sources.snapshots import load_snapshot, refresh
from airq.sources.store import new_folder, note, stored, whole, work_folder


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text readings, as untidy as a CSV export: padding, null tokens, bad dates."""
    items = _table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    )
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nations = _table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    parts = _table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")

    sites = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.concat(F.lit("  "), "n_name", F.lit("\t")).alias("state"),
        F.concat("n_name", F.lit(" "), "c_mktsegment", F.lit(" ")).alias("area"),
    )
    order_sites = orders.join(sites, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "state", "area"
    )

    value = F.floor(F.col("l_extendedprice") / 200)
    band = aqi_band(value)
    return (
        items.join(order_sites.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.when((F.col("l_quantity") == 7) & (F.col("l_tax") == 0.0), "31-02-2020")
            .otherwise(F.date_format(F.col("l_shipdate").cast("date"), "d-M-yyyy")).alias("date"),
            "state",
            "area",
            F.col("l_linenumber").cast("string").alias("number_of_monitoring_stations"),
            F.when(F.col("l_quantity") == 13, None)
            .otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" , "), "p_type"))
            .alias("prominent_pollutants"),
            F.when(F.col("l_quantity") == 1, "").otherwise(value.cast("string")).alias("aqi_value"),
            F.when((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.0), "NA")
            .when(band == "Good", " Good")
            .when(band == "Moderate", "Moderate ")
            .otherwise(band).alias("air_quality_status"),
            F.lit("x").alias("note"),
            F.lit("u").alias("unit"),
        )
    )


def cleaned_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table as one lazy plan over the test tables."""
    return clean(missing_to_null(raw_readings(spark, sf_dir)))


TABLES = ("lineitem", "orders", "customer", "nation", "part")
# (application, tables) -> path of their CSV copy
_csv: dict[tuple, str] = {}


def inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in TABLES]


def readings(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The cleaned table, stored once per application and read back per query."""
    return stored(spark, sf_dir, lambda: cleaned_readings(spark, sf_dir), inputs(sf_dir), refresh=refresh)


def write_raw_csv(raw: DataFrame, path: str, mode: str = "error", by: str | None = None) -> None:
    """Write text readings as CSV, padding kept, in folders ``by`` a column if one is given.

    The mode ``dynamic`` replaces the folders that ``raw`` has rows for.
    """
    writer = (
        raw.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if mode == "dynamic":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    (writer.partitionBy(by) if by else writer).csv(path)


def _shared(spark: SparkSession, folder: str | None) -> str:
    """The shared folder; a local session without one, as in a test, gets a temporary one."""
    found = work_folder(spark, folder)
    if found is None and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="airq-")
    if found is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder to write files")
    return found


def readings_through_csv(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The cleaned table, by way of one CSV copy per application in the shared folder."""
    folder = _shared(spark, folder)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _csv or not whole(spark, _csv[key]):
        path = new_folder(spark, "csv", folder)
        write_raw_csv(raw_readings(spark, sf_dir), path)
        note(spark, path)
        _csv[key] = path
    return clean(read_readings(spark, _csv[key]))


def deliver(spark: SparkSession, sf_dir: str, path: str) -> list[int]:
    """Two deliveries of the readings as CSV files, with a refresh of the table after each; the versions.

    The first lacks a quarter, has a draft of another one and a file that is withdrawn later. The
    second brings what was missing, replaces the draft and withdraws that file.
    """
    raw = raw_readings(spark, sf_dir)
    quarter = F.pmod(F.xxhash64(*raw.columns), F.lit(4)).cast("int")
    drafts = quarter.isin(1, 2)
    given = raw.withColumns({
        "delivery": F.when(quarter == 2, 9).otherwise(quarter),
        "state": F.when(drafts, "draft").otherwise(F.col("state"))})
    files = f"{path}/input"
    write_raw_csv(given, files, by="delivery")
    first = refresh(spark, f"{path}/table", [files])
    # Only the folders of the rows that are written are replaced.
    write_raw_csv(raw.withColumn("delivery", quarter).filter(drafts), files, "dynamic", "delivery")
    write_raw_csv(raw.limit(0), f"{files}/delivery=9", "overwrite")
    return [first, refresh(spark, f"{path}/table", [files])]


def readings_incremental(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The cleaned table as it stands after two deliveries (see ``deliver``)."""
    path = new_folder(spark, "growing", _shared(spark, folder))
    return load_snapshot(spark, f"{path}/table", deliver(spark, sf_dir, path)[-1])


def damaged_intake(spark: SparkSession, sf_dir: str, folder: str | None = None) -> Intake:
    """The readings with further bad cells, by way of CSV, and what cleaning rejects of them."""
    number, value = F.col("number_of_monitoring_stations"), F.col("aqi_value")
    damaged = raw_readings(spark, sf_dir).withColumns({
        "number_of_monitoring_stations": F.when(number == "7", "seven").otherwise(number),
        "aqi_value": F.when(value.try_cast("int") % 100 == 11, F.concat(value, F.lit(" ug"))).otherwise(value),
        "air_quality_status": F.when(value.try_cast("int") % 100 == 12, " Unknown").otherwise(F.col("air_quality_status")),
    })
    path = new_folder(spark, "damaged", _shared(spark, folder))
    write_raw_csv(damaged, f"{path}/csv")
    return take_in(spark, f"{path}/csv", f"{path}/rows")
