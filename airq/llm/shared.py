"""What the operators of this package share: written tables, payloads, small checks."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id where ids are compared: it sorts last.
NO_ID = np.iinfo(np.int64).max


#: Folders chosen for local sessions without a setting, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    The setting is read from the session. Only where neither it nor a checkpoint
    directory of the context is set, and the master is local (as in tests), a
    temporary folder is chosen; a cluster without the setting is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how finely data is dealt out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def need(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` when a column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"the table lacks the columns {absent}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def packed(*arrays) -> bytes:
    """Arrays or bytes as one compressed payload."""
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpacked(payload: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(payload))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
