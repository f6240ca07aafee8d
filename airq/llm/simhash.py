"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 * r`` bits apart share a variant at most ``r`` bits from
each. Every fingerprint therefore emits all variants within half the radius, the
variants are shuffled, and fingerprints that meet in one are linked.

Variants travel in groups: their leading bits name a bucket, and a fingerprint is
sent once to every bucket that holds a variant of it (the buckets within ``r``
flips of its leading bits). The bucket's task makes the variants, sorts them and
links all that share one to the first of them: any two of these are at most ``2 * r`` bits
apart, so no pairs are listed, however many meet. A bucket with many
variants is split by further bits until a part fits in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.llm.components import components
from airq.llm.rolling import run_starts
from airq.llm.shared import need, packed, partitions, unpacked, written

BITS = 64
#: Variants that a task holds at once, about 16 bytes each.
HELD = 1 << 21


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; zero without words, fewer words are one shingle.

    A-Z are lower-cased, words end at ASCII white space, and a bit is set when
    over half of all shingles, repeats included, have it set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    stops = ends[width - 1:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: one row per document, ``fp`` as a signed long."""
    need(docs, "doc_id", "text")

    def make(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in b.column("text")], dtype=np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def masks(n_bits: int, flips: int) -> list[np.ndarray]:
    """For every number of flips up to ``flips``: all masks of that many of the low bits."""
    one = np.uint64(1) << np.arange(n_bits, dtype=np.uint64)
    levels = [np.zeros(1, dtype=np.uint64)]
    tops = np.full(1, -1)
    for _ in range(flips):
        rows = [(levels[-1][tops < b] | one[b], b) for b in range(n_bits)]
        levels.append(np.concatenate([r for r, _ in rows]) if n_bits else np.zeros(0, dtype=np.uint64))
        tops = np.concatenate([np.full(len(r), b) for r, b in rows]) if n_bits else np.zeros(0)
    return levels


def _linked(fps: np.ndarray, spare: np.ndarray, low: int, flips: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) links of fingerprints that share a variant.

    All variants here agree above bit ``low``; a fingerprint may still flip
    ``spare`` of the bits below it.
    """
    if len(fps) < 2:
        return
    ball = masks(low, flips)
    per = np.cumsum([len(m) for m in ball])
    rows = np.arange(len(fps))
    if per[spare].sum() > held and low > 4:
        cut = low - 4
        nibble = (fps >> np.uint64(cut)) & np.uint64(15)
        for child in range(16):
            left = spare - np.bitwise_count(nibble ^ np.uint64(child)).astype(np.int64)
            inside = np.flatnonzero(left >= 0)
            for a, b in _linked(fps[inside], left[inside], cut, flips, held):
                yield inside[a], inside[b]
        return
    mask = np.uint64((1 << low) - 1) if low < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    variants, owners = [], []
    for s in range(flips + 1):
        own = rows[spare == s]
        if len(own):
            ms = np.concatenate(ball[: s + 1])
            variants.append(((fps[own] & mask)[:, None] ^ ms).ravel())
            owners.append(np.repeat(own, len(ms)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    first = run_starts(variants)
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    rest = np.flatnonzero(~first)
    yield owners[head[rest]], owners[rest]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each row's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        left = label[a] != label[b]
        a, b = a[left], b[left]
        if (before == label).all() and not left.any():
            break
    return label


def bucket_links(fps: np.ndarray, bucket: int, top: int, flips: int, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """Verified (fingerprint, least linked fingerprint) pairs of one bucket."""
    fps = np.unique(fps)
    low = BITS - top
    lead = (fps >> np.uint64(low)) if top else np.zeros(len(fps), dtype=np.uint64)
    spare = flips - np.bitwise_count(lead ^ np.uint64(bucket)).astype(np.int64)
    seen = np.zeros(0, dtype=np.int64)
    for a, b in _linked(fps, spare, low, flips, held):
        seen = np.union1d(seen, np.minimum(a, b) * len(fps) + np.maximum(a, b))
    a, b = np.divmod(seen, max(1, len(fps)))
    near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * flips
    label = forest(len(fps), a[near], b[near])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def near_links(fps: DataFrame, radius: int = 4, top: int | None = None, held: int = HELD) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints (column ``fp``) at most ``radius`` bits apart."""
    if radius % 2:
        raise ValueError("radius must be even")
    flips = radius // 2
    top = min(24, max(6, (2 * partitions(fps.sparkSession) - 1).bit_length())) if top is None else top
    near = np.concatenate(masks(top, flips))

    def emit(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            lead = (own >> np.uint64(BITS - top))
            to = (lead[:, None] ^ near).ravel()
            what = np.repeat(own, len(near))
            order = np.argsort(to, kind="stable")
            to, what = to[order], what[order]
            starts = np.flatnonzero(run_starts(to))
            parts = [packed(p) for p in np.split(what, starts[1:])] if len(to) else []
            yield pa.record_batch({"bucket": pa.array(to[starts].astype(np.int64)), "payload": pa.array(parts, pa.binary())})

    def link(key, table):
        own = np.concatenate([unpacked(p.as_py())[0] for p in table["payload"]])
        u, v = bucket_links(own, key[0].as_py(), top, flips, held)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return fps.select("fp").distinct().mapInArrow(emit, "bucket long, payload binary").groupBy("bucket").applyInArrow(link, "u long, v long")


def simhash_groups(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is
    the smallest doc_id reachable over links. A null text has no words, and
    documents without words share fingerprint zero, linked like any other. Null ids
    never name a component unless it has no other id. Repeated rows stay; an
    empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, width, seed))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes, radius))
    rooted = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = written(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one that names it.

    Rows without a doc_id stay. Columns are those of ``docs``.
    """
    groups = simhash_groups(docs.filter("doc_id IS NOT NULL"), radius, width, seed)
    drop = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
