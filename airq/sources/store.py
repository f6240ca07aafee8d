"""The cleaned table, written once and shared by all operators of an application."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from airq.schema import STATE, YEAR
from airq.sources.files import fingerprint, input_files

# (application, name) -> (path of the copy, frame that reads it, fingerprint of its input files)
_kept: dict[tuple, tuple[str, DataFrame, tuple | None]] = {}
# path of a copy -> number and bytes of its files when it had been written
_written: dict[str, tuple[int, int] | None] = {}


def _files(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Number and bytes of the files under ``path``, None if it is gone. They are listed, not opened."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None
    held = system.getContentSummary(place)
    return held.getFileCount(), held.getLength()


def note(spark: SparkSession, *paths: str) -> None:
    """Remember what the copies at ``paths``, just written, consist of."""
    for path in paths:
        _written[path] = _files(spark, path)


def whole(spark: SparkSession, *paths: str) -> bool:
    """Whether there are copies at ``paths`` and all have the files that ``note`` saw.

    Work folders are cleared by other hands, also while an application runs; a copy that is not whole is made anew.
    """
    return bool(paths) and all(_written.get(path) is not None and _files(spark, path) == _written[path] for path in paths)


# (application, folder) -> whether what tasks write there comes back
_comes_back: dict[tuple, bool] = {}


def comes_back(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and other tasks find what tasks write to ``folder``; tried once per application.

    Files go out from several tasks a core and are read again. Where machines do not share the folder,
    some are missing or the attempt fails, in whichever way: then the answer is no.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _comes_back:
        try:
            n, path = 4 * spark.sparkContext.defaultParallelism, f"{folder.rstrip('/')}/airq-probe-{uuid.uuid4().hex}"
            spark.range(0, n, 1, n).write.parquet(path)
            _comes_back[key] = spark.read.schema("id long").parquet(path).distinct().count() == n
        except Exception:
            _comes_back[key] = False
    return _comes_back[key]


def work_folder(spark: SparkSession, folder: str | None = None) -> str | None:
    """Folder that every executor can reach, or None, on any kind of master.

    ``folder`` if given, else the one named in ``spark.checkpoint.dir``, else the
    context's checkpoint folder. On a cluster a path that is local to each machine
    is refused: one without a scheme while the default file system is the local one, unless
    it is shared all the same (a mounted folder, or all on one machine), see ``comes_back``.
    The executors of ``local-cluster`` are processes of one machine and share its paths.
    """
    context = spark.sparkContext
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        return None
    one_machine = context.master.split("[")[0] in ("local", "local-cluster")
    if not one_machine and ":" not in folder:
        default = context._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        if default.startswith("file:") and not comes_back(spark, folder):
            raise ValueError(f"{folder} is local to each machine; name a shared folder with its scheme")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str, folder: str | None = None) -> str | None:
    """A path in the work folder that nothing has used yet."""
    base = work_folder(spark, folder)
    if base is None:
        return None
    return f"{base}/airq-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}/{name}"


def write_readings(readings: DataFrame, path: str) -> None:
    """Write cleaned readings as parquet, one folder per year.

    Year filters then prune folders. Rows are rebalanced by year first: adaptive
    execution merges small pieces and splits a hot year, so the number of files
    follows the data and not tasks times years. Inside a file rows are sorted by
    state, so state filters skip row groups and the text columns encode well.
    """
    dealt = readings.hint("rebalance", YEAR)
    dealt.sortWithinPartitions(YEAR, STATE).write.partitionBy(YEAR).parquet(path)


def load_readings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read what ``write_readings`` wrote, columns in the order of ``schema``."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def stored(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    inputs: Iterable[str] = (),
    folder: str | None = None,
    refresh: bool = False,
) -> DataFrame:
    """The stored copy of ``build()``, written on the first call per application.

    ``name`` identifies it. The frame that reads the copy is kept; later calls open no file, they list those
    of the copy and write it anew if any is gone. With
    ``refresh`` the files under ``inputs`` are listed once more, in bulk, and the copy is written anew if
    any was added, removed or rewritten (``snapshots`` follows single files instead).
    Without a shared folder the lazy plan is returned with a warning, which gives the
    same rows without the reuse.
    """
    base = work_folder(spark, folder)
    if base is None:
        warnings.warn("no shared folder (spark.checkpoint.dir): the cleaned table is not stored", stacklevel=2)
        return build()
    key, inputs = (spark.sparkContext.applicationId, name), list(inputs)
    held = key in _kept and whole(spark, _kept[key][0])
    found = fingerprint(input_files(spark, inputs)) if inputs and (refresh or not held) else None
    if held and (found is None or found == _kept[key][2]):
        path, kept, found = _kept[key]
        if kept.sparkSession is not spark:
            kept = load_readings(spark, path, kept.schema)
    else:
        readings = build()
        path = new_folder(spark, "readings", base)
        write_readings(readings, path)
        note(spark, path)
        kept = load_readings(spark, path, readings.schema)
    _kept[key] = (path, kept, found)
    return kept


def stored_path(spark: SparkSession, name: str) -> str | None:
    """Folder of the stored copy ``name``, None where it was not stored."""
    kept = _kept.get((spark.sparkContext.applicationId, name))
    return kept[0] if kept else None
