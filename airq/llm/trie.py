"""Prefix trie of conversations by whole-sequence collapse.

Conversations that are the same turn by turn become one weighted sequence with a list of
the conversations that end there. A sequence that is a proper prefix of another one is
no leaf (an anti-join tells). Every sequence then adds its weight to each of its
prefixes, and the sums per prefix are the nodes of the trie.

Texts stay where they are read: a turn travels as two hashes of role and text and the
text's length. A prefix is known by its depth and two 64-bit values, each the exclusive-or of
one hash per turn that covers the turn's depth. Running values over a long
conversation are taken in blocks of turns, so no task needs a whole conversation;
turns are numbered inside ranges of a global order for the same reason.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airq.llm.shared import need, written

#: A conversation starts with fewer turns than this of the first one of its hundred.
SHARED = 6
#: Turns of a block of running values, and ids of a piece of an end list.
BLOCK, PIECE = 1024, 1 << 15
NODE = ("depth", "ka", "kb")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``: 1 for the first row of each key, and so on in ``order``.

    Rows are dealt by ranges of key and order, so a key with very many rows spans
    several tasks; each task counts its own, and the counts of earlier tasks are added.
    """
    dealt = written(
        rows.repartitionByRange(key, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(key, *[F.col(c).asc_nulls_first() for c in order])
        # Numbers rise along a task's rows; the bits above the lowest 33 name the task.
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("task", F.shiftright("at", 33)))
    runs = dealt.groupBy(key, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = runs.selectExpr(
        key, "task", f"first - coalesce(sum(held) OVER (PARTITION BY {key} ORDER BY task "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS origin")
    return dealt.join(before, [key, "task"]).withColumn("place", F.col("at") - F.col("origin") + 1).drop("at", "task", "origin")


def running(rows: DataFrame, key: str, place: str, sums: dict[str, str], backwards: bool = False) -> DataFrame:
    """``rows`` with running aggregates along ``place``: SQL aggregate and column by new name.

    ``sums`` maps a new column to ``bit_xor(x)`` or ``sum(x)``. Blocks of places are run on
    their own, then the totals of the blocks before are added (for few keys there are any).
    """
    way = "DESC" if backwards else "ASC"
    rows = written(rows.withColumn("block", F.floor((F.col(place) - 1) / BLOCK)))
    inside = rows.selectExpr("*", *[
        f"{call} OVER (PARTITION BY {key}, block ORDER BY {place} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {name}"
        for name, call in sums.items()])
    long = rows.groupBy(key).agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high")
    totals = rows.join(long.select(key), key, "left_semi").groupBy(key, "block").agg(
        *[F.expr(call).alias(f"{name}_block") for name, call in sums.items()])
    over = f"OVER (PARTITION BY {key} ORDER BY block {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier = totals.selectExpr(key, "block", *[f"{_over(call, name)} {over} AS {name}_earlier" for name, call in sums.items()])
    joined = inside.join(earlier, [key, "block"], "left")
    return joined.select(
        *[F.col(c) for c in rows.columns if c != "block"],
        *[_plus(call, F.col(name), F.coalesce(f"{name}_earlier", F.lit(0))).alias(name) for name, call in sums.items()])


def _over(call: str, name: str) -> str:
    return f"{call.split('(')[0]}({name}_block)"


def _plus(call: str, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if call.startswith("bit_xor") else a + b


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns, and one row per conversation with the number of its turns.

    ``conv_id, depth, length, ta, tb, points`` per turn, ``conv_id, length`` per conversation.
    """
    need(conversations, "conv_id", "turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.char_length(text).cast("long").alias("points"))
    turns = written(numbered(turns, "conv_id", ["turn", "a", "b"]))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = sizes.selectExpr(
        "conv_id", "own", "conv_id - conv_id % 100 AS base",
        f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {SHARED} AS asked")
    base = sizes.selectExpr("conv_id AS base", "own AS offered")
    heads = written(heads.join(base, "base", "left").selectExpr(
        "conv_id", "base", "asked", "least(asked, coalesce(offered, 0L)) AS taken",
        "least(asked, coalesce(offered, 0L)) + greatest(own - asked, 0L) AS length"))
    kept = turns.join(heads, "conv_id").filter("place > asked").selectExpr(
        "conv_id", "place - asked + taken AS depth", "length", "a", "b", "points")
    first = turns.filter(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    lent = heads.filter("taken > 0").join(first, "base").filter("place <= taken").selectExpr(
        "conv_id", "place AS depth", "length", "a", "b", "points")
    rows = kept.unionByName(lent).select(
        "conv_id", "depth", "length", _hash(3, "depth", "a", "b").alias("ta"), _hash(4, "depth", "a", "b").alias("tb"), "points")
    return rows, heads.select("conv_id", "length")


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of every node: columns of ``NODE``, ``ends_sha256``.

    ``ends`` has the node and a ``conv_id`` per row. Ids are dealt by ranges of node and id
    and joined to pieces there; a node's pieces then pass, in order, through one
    task that holds a piece and the state of the digest.
    """
    keys = [*NODE]

    def pieces(batches):
        node, first, held = None, None, []

        def ready():
            return pa.RecordBatch.from_pylist([dict(zip(keys, node), first=first, piece=",".join(held))], schema=shape)

        shape = pa.schema([*[(k, pa.int64()) for k in keys], ("first", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            out = []
            for *own, conv in zip(*[batch.column(k).to_pylist() for k in (*keys, "conv_id")]):
                if own != node or len(held) == PIECE:
                    if held:
                        out.append(ready())
                    node, first, held = own, conv, []
                held.append(str(conv))
            yield from pa.Table.from_batches(out, shape).combine_chunks().to_batches() if out else []
        if held:
            yield ready()

    def digest(batches):
        node, sha = None, None
        shape = pa.schema([*[(k, pa.int64()) for k in keys], ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for *own, piece in zip(*[batch.column(k).to_pylist() for k in (*keys, "piece")]):
                if own != node:
                    if node is not None:
                        out.append(dict(zip(keys, node), ends_sha256=sha.hexdigest()))
                    node, sha = own, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_pylist(out, schema=shape)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, node), ends_sha256=sha.hexdigest())], schema=shape)

    names = "depth long, ka long, kb long"
    by = ["ka", "kb", "depth"]
    joined = ends.select(*keys, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(
        pieces, f"{names}, first long, piece string")
    return joined.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, f"{names}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Conversations are rebuilt as in ``rebuilt``: the first turns of the first of their
    hundred (a negative id belongs to the hundred nearer to zero), then their own. Turns are in the
    order of ``turn``, null first; equal turn numbers go by a hash of role and text. A
    null role or text is empty, rows without a conv_id belong to no conversation and are left out, repeated
    rows are turns of their own. Without conversations there are no nodes. Other columns
    are ignored.
    """
    keys = [*NODE]
    turns, heads = rebuilt(conversations)
    paths = written(running(turns, "conv_id", "depth", {"ka": "bit_xor(ta)", "kb": "bit_xor(tb)"}))
    empty = heads.filter("length = 0").selectExpr("conv_id", "0L AS depth", "0L AS ka", "0L AS kb")
    ends = paths.filter("depth = length").select("conv_id", *keys).unionByName(empty)

    # The collapse: one weighted sequence for all conversations that end at a node.
    sequences = written(ends.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")))
    own = paths.join(sequences.select("conv_id", "weight"), "conv_id").selectExpr(
        "conv_id", "weight", "depth", "ka", "kb", "ka ^ ta AS pa", "kb ^ tb AS pb", "depth = length AS last", "points")
    root = sequences.selectExpr(
        "conv_id", "weight", "0L AS depth", "0L AS ka", "0L AS kb", "NULL AS pa", "NULL AS pb", "depth = 0 AS last", "0L AS points")
    prefixes = written(own.unionByName(root))
    inner = prefixes.filter("NOT last").select(*keys).distinct()
    leaves = sequences.join(inner, keys, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    weighted = prefixes.join(leaves, "conv_id", "left")
    nodes = written(weighted.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("points").alias("points")))

    # A node's own saving is counted by the sequence that names it, along with all that
    # this sequence names below: its running sum from the end.
    saving = nodes.selectExpr("conv_id", "depth", "(n_convs - 1) * points AS saving")
    along = prefixes.join(saving, ["conv_id", "depth"], "left").selectExpr(
        "conv_id", "depth + 1 AS place", "ka", "kb", "coalesce(saving, 0L) AS saving")
    below = running(along, "conv_id", "place", {"saved": "sum(saving)"}, backwards=True)
    saved = below.withColumn("depth", F.col("place") - 1).groupBy(*keys).agg(F.sum("saved").alias("saved_tokens"))

    children = nodes.filter("depth > 0").selectExpr("depth - 1 AS depth", "pa AS ka", "pb AS kb").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.selectExpr("depth + 1 AS depth", "ka AS pa", "kb AS pb", "conv_id AS parent_conv_id")
    return (
        nodes.join(parents, ["depth", "pa", "pb"], "left")
        .join(written(children), keys, "left").join(written(saved), keys, "left").join(written(end_digests(ends)), keys, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )
