"""Input files as rows, listed in bulk by Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``uri, path, length, modified`` of every file under ``paths``; no content is read.

    Many folders are listed by tasks, as for any table of files. ``uri`` is what
    ``input_file_name()`` gives for the rows of the file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select(
        F.input_file_name().alias("uri"), "path", "length", F.col("modificationTime").alias("modified"))


def fingerprint(files: DataFrame) -> tuple:
    """A few numbers that change when a file is added, removed or rewritten."""
    return tuple(files.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("uri", "length", "modified"))).first())
