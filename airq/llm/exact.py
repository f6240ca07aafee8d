"""Exact deduplication of a new batch against stored, immutable snapshots.

A snapshot keeps one row per distinct text in exact buckets, and per bucket a
static binary-fuse filter over the texts' digests. A new batch is grouped by digest
on its own. Its groups are screened by the filters: what a filter turns away
is new for certain; what passes joins the exact buckets, where the bytes are
compared. Only texts that pass a filter move, one per group.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.llm.peeling import Filter, Shape, build_filter
from airq.llm.shared import need, packed, partitions, text_or_empty, unpacked, written


class Snapshot(NamedTuple):
    """``buckets``: bucket, sha, body, keep_id, n. ``filters``: bucket, payload."""

    buckets: DataFrame
    filters: DataFrame
    n_buckets: int


def _digests(docs: DataFrame) -> DataFrame:
    need(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("sha"))


def _groups(digests: DataFrame, n_buckets: int) -> DataFrame:
    """One row per digest; rows are combined before the shuffle, so a hot text is one row a task."""
    key = F.xxhash64("sha")
    return digests.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).select(
        F.pmod(key, F.lit(n_buckets)).cast("int").alias("bucket"), key.alias("key"), "sha", "keep_id", "n")


def _bodies(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """``groups`` with the text of one row each, that of ``keep_id``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("keep_id"), text_or_empty().alias("body"))
    texts = texts.withColumn("sha", F.sha2("body", 256))
    # Repeated rows would come back twice; they are equal, so any of them serves.
    return (
        groups.join(texts, groups["keep_id"].eqNullSafe(texts["keep_id"]) & (groups["sha"] == texts["sha"]), "left")
        .drop(texts["keep_id"]).drop(texts["sha"]).dropDuplicates(["sha"])
    )


def build_snapshot(docs: DataFrame, n_buckets: int | None = None) -> Snapshot:
    """Write the exact buckets of ``docs`` and their filters.

    Size ``n_buckets`` so that a bucket has some hundred thousand digests: a
    filter takes a little over two bytes for each while it is used.
    """
    n_buckets = n_buckets or partitions(docs.sparkSession)
    groups = written(_groups(_digests(docs), n_buckets))
    buckets = written(_bodies(groups, docs).select("bucket", "key", "sha", "body", "keep_id", "n"))

    def build(key, table):
        keys = np.unique(table["key"].to_numpy().view(np.uint64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "payload": [packed(*build_filter(keys))]})

    filters = groups.select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket int, payload binary")
    return Snapshot(buckets, written(filters), n_buckets)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``groups`` that the filter of their bucket lets pass."""
    def screen(key, left, right):
        passes = np.zeros(left.num_rows, dtype=bool)
        for payload in right["payload"]:
            shape, table = unpacked(payload.as_py())
            passes |= Filter(Shape(*shape), table).may_hold(left["key"].to_numpy().view(np.uint64))
        return left.filter(pa.array(passes))

    return groups.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(screen, groups.schema)


def exact_dedup(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Groups of equal texts over a snapshot and a new batch: ``sha, keep_id, group_size``.

    Of equal texts the row with the largest doc_id stays. A null text counts as
    empty, a null doc_id is smaller than any other. Rows repeated with the same
    id and text each count. Either side may be empty; other columns are ignored.
    """
    groups = written(_groups(_digests(batch), snapshot.n_buckets))
    hits = _bodies(screened(groups, snapshot), batch).select("sha", "body", "keep_id", "n")
    stored = snapshot.buckets.select("sha", F.col("body").alias("stored_body"))
    known = written(hits.join(stored, "sha").filter(
        F.when(F.col("body") == F.col("stored_body"), True)
        .otherwise(F.raise_error(F.lit("different texts with one digest")).cast("boolean"))
    ).select("sha", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n")))
    fresh = groups.join(known, "sha", "left_anti").select("sha", "keep_id", F.col("n").alias("group_size"))
    merged = snapshot.buckets.select("sha", "keep_id", "n").join(known, "sha", "left").select(
        "sha", F.greatest("keep_id", "new_id").alias("keep_id"),
        (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("group_size"))
    return fresh.unionByName(merged)


def with_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    A hot text is one key of the join; both sides come from written tables, so
    adaptive execution can split its rows.
    """
    rows = written(_digests(docs))
    return rows.join(written(groups), "sha", "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))
