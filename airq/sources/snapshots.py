"""A table of cleaned readings that follows its input files, in snapshots.

A refresh compares the input files with those of the last snapshot. Only new and replaced
files are cleaned, into a batch of their own; rows of replaced and removed files
stay in their batch and are left out when it is read, until so many are dead that the
batch is put together anew. A snapshot is a manifest (which version of which file
lies in which batch) and becomes visible by the creation of one small file, so
readers see the old or the new state and a failed refresh none.

    table/data/<batch>/year=<year>/…   rows with the file version they came from
    table/manifests/<name>/…           one row per file version
    table/versions/<number>            names the manifest
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from airq.sources.files import input_files
from airq.sources.readings import clean_readings
from airq.sources.store import load_readings, write_readings

#: Column of the file version a row came from.
SOURCE = "_source"
#: Dead file versions of a batch, and batches of a table, beyond which batches are put together anew.
MOST_DEAD, MOST_BATCHES = 200, 16
MANIFEST = "uri STRING, length BIGINT, modified TIMESTAMP, source STRING, batch STRING, live BOOLEAN"

Clean = Callable[[SparkSession, list[str]], DataFrame]
# (application, table, version) -> frame that reads it
_frames: dict[tuple, DataFrame] = {}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of all snapshots, newest first."""
    fs, folder = _file_system(spark, f"{table}/versions")
    if not fs.exists(folder):
        return []
    return sorted((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True)


def _pointer(spark: SparkSession, table: str, version: int) -> dict | None:
    """What a version names; None while it is still being written."""
    fs, file = _file_system(spark, f"{table}/versions/{version:08d}")
    stream = fs.open(file)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def _newest(spark: SparkSession, table: str) -> tuple[int, dict | None]:
    for version in _versions(spark, table):
        named = _pointer(spark, table, version)
        if named is not None:
            return version, named
    return 0, None


def _publish(spark: SparkSession, table: str, version: int, named: dict) -> None:
    """The switch: creating the version's file fails if another refresh was faster."""
    fs, file = _file_system(spark, f"{table}/versions/{version:08d}")
    stream = fs.create(file, False)
    stream.write(bytearray(json.dumps(named) + "\n", "utf-8"))
    stream.close()


def manifest(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """One row per file version of a snapshot, see ``MANIFEST``; rows that are not live wait in their batch."""
    named = _newest(spark, table)[1] if version is None else _pointer(spark, table, version)
    if named is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{table}/manifests/{named['manifest']}")


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Input files; a folder that is gone has none."""
    found = []
    for path in paths:
        try:
            found.append(input_files(spark, [path]))
        except AnalysisException as absent:
            if "PATH_NOT_FOUND" not in (absent.getCondition() or ""):
                raise
    empty = "uri STRING, path STRING, length BIGINT, modified TIMESTAMP"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)


def changes(spark: SparkSession, table: str, paths: Iterable[str]) -> DataFrame:
    """``uri, path, length, modified, source, batch, state``: input files against the newest snapshot.

    ``state`` is ``new``, ``replaced``, ``same`` or ``removed``; the last has no ``path``.
    """
    files = _listed(spark, list(paths)).alias("f")
    held = manifest(spark, table).filter("live").alias("m")
    state = (
        F.when(F.col("m.uri").isNull(), "new").when(F.col("f.uri").isNull(), "removed")
        .when((F.col("f.length") == F.col("m.length")) & (F.col("f.modified") == F.col("m.modified")), "same")
        .otherwise("replaced"))
    return files.join(held, F.col("f.uri") == F.col("m.uri"), "full").select(
        F.coalesce("f.uri", "m.uri").alias("uri"), "f.path", F.coalesce("f.length", "m.length").alias("length"),
        F.coalesce("f.modified", "m.modified").alias("modified"), "m.source", "m.batch", state.alias("state"))


def _batch(spark: SparkSession, table: str, batch: str, schema: StructType, dead: Iterable[str] = ()) -> DataFrame:
    """A batch's live rows with their file version."""
    wide = StructType([*schema.fields, StructField(SOURCE, StringType())])
    rows = load_readings(spark, f"{table}/data/{batch}", wide)
    dead = list(dead)
    return rows.filter(~F.col(SOURCE).isin(dead)) if dead else rows


def exists(spark: SparkSession, path: str) -> bool:
    fs, file = _file_system(spark, path)
    return fs.exists(file)


def batches(rows: DataFrame) -> dict[str, list[str]]:
    """Batches of a manifest with the names of their dead file versions."""
    return {b: dead for b, (_, dead) in sorted(_dead(rows).items())}


def read_batch(spark: SparkSession, table: str, batch: str, version: int | None = None) -> DataFrame:
    """All rows of a batch, dead ones too, with the column ``SOURCE``."""
    named = _newest(spark, table)[1] if version is None else _pointer(spark, table, version)
    return _batch(spark, table, batch, StructType.fromJson(json.loads(named["schema"])))


def _dead(rows: DataFrame) -> dict[str, tuple[int, list[str]]]:
    """Live file versions and names of the dead ones, per batch: few by the bounds above."""
    counted = rows.groupBy("batch").agg(
        F.count_if("live").alias("live"), F.collect_set(F.when(~F.col("live"), F.col("source"))).alias("dead"))
    return {r["batch"]: (r["live"], sorted(r["dead"])) for r in counted.collect()}


def refresh(spark: SparkSession, table: str, paths: Iterable[str], clean: Clean = clean_readings) -> int:
    """Bring ``table`` up to its input files and return the version; nothing is written without changes.

    ``clean`` turns a list of files into cleaned readings and is given the new and replaced ones
    alone. Of two refreshes at one time, one fails and changes nothing.
    """
    version, named = _newest(spark, table)
    found = changes(spark, table, paths).persist()
    try:
        todo = [r["path"] for r in found.filter("state IN ('new', 'replaced')").select("path").collect()]
        if named is not None and not todo and found.filter("state = 'removed'").isEmpty():
            return version
        batch = f"{version + 1:08d}-{uuid.uuid4().hex}"
        schema = StructType.fromJson(json.loads(named["schema"])) if named else None
        if todo:
            rows = clean(spark, todo)
            schema = rows.schema
            version_of = F.md5(F.concat(F.input_file_name(), F.lit(batch)))
            write_readings(rows.withColumn(SOURCE, version_of), f"{table}/data/{batch}")
        if schema is None:
            raise ValueError("there are no input files to make a table of")
        new = found.filter("state IN ('new', 'replaced')").select(
            "uri", "length", "modified", F.md5(F.concat("uri", F.lit(batch))).alias("source"),
            F.lit(batch).alias("batch"), F.lit(True).alias("live"))
        gone = found.filter("state IN ('removed', 'replaced')").select("source", F.lit(True).alias("gone"))
        old = manifest(spark, table).join(gone, "source", "left").withColumn(
            "live", F.col("live") & F.col("gone").isNull()).drop("gone")
        rows = old.unionByName(new).select("uri", "length", "modified", "source", "batch", "live")
        name = _compacted(spark, table, rows, schema, f"{version + 1:08d}-{uuid.uuid4().hex}")
        _publish(spark, table, version + 1, {"manifest": name, "schema": schema.json()})
        return version + 1
    finally:
        found.unpersist()


def _compacted(spark: SparkSession, table: str, rows: DataFrame, schema: StructType, name: str) -> str:
    """Write the manifest ``rows``; batches with too many dead file versions become a new one first."""
    rows.write.parquet(f"{table}/manifests/{name}")
    rows = spark.read.schema(MANIFEST).parquet(f"{table}/manifests/{name}")
    batches = _dead(rows)
    empty = [b for b, (live, _) in batches.items() if not live]
    poor = [b for b, (live, dead) in batches.items() if live and (len(dead) > MOST_DEAD or len(dead) > live)]
    if len(batches) > MOST_BATCHES:  # all but the one with most files
        poor = sorted(set(batches) - set(empty), key=lambda b: batches[b][0])[:-1]
    if not empty and not poor:
        return name
    batch = f"{name}-merged"
    if poor:
        parts = [_batch(spark, table, b, schema, batches[b][1]) for b in poor]
        write_readings(reduce(DataFrame.unionByName, parts), f"{table}/data/{batch}")
    kept = rows.filter(~F.col("batch").isin([*empty, *poor])).unionByName(
        rows.filter(F.col("batch").isin(poor) & F.col("live")).withColumn("batch", F.lit(batch)))
    kept.write.parquet(f"{table}/manifests/{name}-merged")
    return f"{name}-merged"


def load_snapshot(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The readings of a snapshot, the newest if none is named. The frame stays on that snapshot.

    Batches without dead file versions are read without a filter and without the column that names these.
    """
    if version is None:
        version, _ = _newest(spark, table)
    key = (spark.sparkContext.applicationId, table, version)
    if key in _frames and _frames[key].sparkSession is spark:
        return _frames[key]
    named = _pointer(spark, table, version) if version else None
    if named is None:
        raise ValueError(f"{table} has no version {version or ''}")
    schema = StructType.fromJson(json.loads(named["schema"]))
    batches = _dead(manifest(spark, table, version))
    parts = [_batch(spark, table, b, schema, dead) for b, (_, dead) in sorted(batches.items())]
    frame = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    _frames[key] = frame.select(*schema.fieldNames())
    return _frames[key]
