"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns the arcs of the ring that end in its virtual nodes. A key lies on
the arc that its hash falls in and belongs to that shard until the shard is full;
keys beyond that continue clockwise to the next virtual node whose shard has
room. Capacities differ by one row at most and add up to the number of rows, so
row counts are at most one apart, and a new shard moves only the rows
that it takes and those whose overflow changes.

Keys are taken clockwise, so the keys of an arc are cut into a few runs of ranks,
one per shard. Only the arcs' counts reach the driver, a fixed number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airq.llm.shared import need, partitions

#: Virtual nodes per shard.
NODES = 64


def ring_of(n_shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes, ascending, and their shards."""
    places = sorted(
        (xxhash.xxh64_intdigest(f"{shard}/{node}".encode()) - (1 << 63), shard)
        for shard in range(n_shards) for node in range(nodes)
    )
    return np.array([p for p, _ in places], dtype=np.int64), np.array([s for _, s in places])


def capacities(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def runs_of(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of every run of keys."""
    room, filled, runs, n = list(room), [0] * len(room), [], len(owners)
    for arc, count in enumerate(counts):
        at, rank = arc, 0
        while rank < count:
            shard = owners[at % n]
            take = min(room[shard], count - rank)
            if take:
                runs.append((arc, rank, rank + take, int(shard), filled[shard]))
                room[shard] -= take
                filled[shard] += take
                rank += take
            at += 1
    return runs


def ring_shards(docs: DataFrame, n_shards: int = 16, nodes: int = NODES, cells: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``rows``. ``size`` is the text's bytes plus one (null: none). The ring
    position is the hash of doc_id, or of the text where doc_id is null; rows
    repeated at one position are ordered by checksum and size, equal ones in
    any order. Slots are gapless from 0 in each shard. An empty table gives no rows.

    Rows are ranked within cells, slices of the arcs of equal hash range, whose
    number follows the session's partitions, so no task gets a whole shard.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    bits = max(1, int(4 * (cells or partitions(spark)) - 1).bit_length())
    places, owners = ring_of(n_shards, nodes)
    n_arcs = len(places)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
        F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long")))
        .otherwise(F.xxhash64("text")).alias("position"),
    )

    def arcs(batches):
        for b in batches:
            position = b.column("position").to_numpy()
            arc = np.searchsorted(places, position, side="left") % n_arcs
            cell = arc.astype(np.int64) << np.int64(bits) | ((position >> np.int64(64 - bits)) + (1 << (bits - 1)))
            yield b.append_column("arc", pa.array(arc.astype(np.int32))).append_column("cell", pa.array(cell))

    placed = rows.mapInArrow(arcs, "doc_id long, size long, text_crc32 long, position long, arc int, cell long")
    # At most shards * nodes + 2**bits counts. Past the last node the ring goes on at
    # the first, so arc 0 holds both ends, low positions after high ones.
    held = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    counts, before, half = [0] * n_arcs, [], 1 << (bits - 1)
    low = int(places[0] >> np.int64(64 - bits)) + half if n_arcs else 0
    for cell in sorted(held, key=lambda c: (c >> bits, (c & (2 * half - 1)) <= low if c >> bits == 0 else False, c)):
        arc = cell >> bits
        before.append((cell, counts[arc]))
        counts[arc] += held[cell]
    runs = runs_of(counts, owners, capacities(sum(counts), n_shards))
    run_type = "array<struct<first:long,end:long,shard:int,slot:long>>"
    by_arc: dict[int, list] = {}
    for arc, first, end, shard, slot in runs:
        by_arc.setdefault(arc, []).append((first, end, shard, slot))
    table = spark.createDataFrame(
        [(cell, base, by_arc[cell >> bits]) for cell, base in before], f"cell long, base long, runs {run_type}")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("position", "doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("rank", rank).join(F.broadcast(table), "cell")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    run = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["end"])), F.lit(0))
    return ranked.withColumn("run", run).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"),
        (F.col("run.slot") + F.col("rank") - F.col("run.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
