"""Benchmark decontamination by spaced seeds.

Masks mark some token positions of a short window and ignore the others. Test items
and documents are hashed at the marked positions of every window, and equal hashes
of one mask join. A hit proposes an alignment of document and item; around it the
tokens are compared one by one, and a stretch counts when enough of them agree,
so tokens may be replaced anywhere.

Test items are a stated query set: they are taken in blocks of bounded size, and
every block's hashes and tokens go to the tasks that read the documents.
Documents do not move; their whole texts are read once per block.

Items under ``LEAST`` tokens are too short to tell copying from chance. They are looked up word for
word, by a hash of the whole item at every position, and reported in a column of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.llm.lexer import lexed
from airq.llm.rolling import mix, powers
from airq.llm.shared import need, written

#: Marked token positions of every mask. Whatever three of 16 tokens, or as many of an
#: item of 8 to 15 as may differ, are replaced, one of them still fits (tested).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 7), (0, 1, 2, 3, 7, 8), (0, 2, 3, 4, 5, 6),
         (0, 1, 4, 6, 7, 8), (0, 1, 2, 4, 5, 6), (0, 1, 2, 3, 4, 5))
#: Tokens of a stretch (or the whole item, if shorter), and the share that must agree.
STRETCH, AGREE = 16, 0.8
#: Items with fewer tokens are only looked up word for word.
LEAST = 8
#: Bytes of test text in a block; its index takes about ten times as much in a task.
BLOCK_BYTES = 1 << 20


def seeds(tokens: np.ndarray, mask: Sequence[int], number: int) -> np.ndarray:
    """Hash of the masked tokens of every window."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, (number + 1) % (1 << 64), dtype=np.uint64)
    for place, factor in zip(mask, powers(len(mask) + 1)[1:]):
        total += tokens[place: place + n] * factor
    return mix(total)


class Index:
    """Seeds of a block of test items."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str | None], masks=MASKS, least: int = LEAST):
        self.masks = masks
        self.ids, self.items = [], []
        short: dict[int, list[tuple[int, np.ndarray]]] = {}
        for piece in lexed(pa.array(texts, pa.string())):
            cut = np.searchsorted(piece.doc, np.arange(len(piece.rows) + 1))
            for row, a, b in zip(piece.rows, cut[:-1], cut[1:]):
                if b - a >= least:
                    self.ids.append(ids[row])
                    self.items.append(piece.word[a:b])
                elif b > a:
                    short.setdefault(int(b - a), []).append((ids[row], piece.word[a:b]))
        # Per length: hashes in order, the item of each and its tokens.
        self.short = {}
        for n, found in short.items():
            hashes = np.concatenate([seeds(tokens, range(n), -n) for _, tokens in found])
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], np.array([found[i][0] for i in order]), np.stack([found[i][1] for i in order])
        found = [(seeds(tokens, mask, m), i) for m, mask in enumerate(masks) for i, tokens in enumerate(self.items)]
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *[h for h, _ in found]])
        item = np.repeat([i for _, i in found], [len(h) for h, _ in found]).astype(np.int64)
        place = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(len(h)) for h, _ in found]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.low = np.zeros(1 << 20, dtype=bool)  # turns most document seeds away
        self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def alignments(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, place of its first token among ``tokens``) of every hit."""
        for m, mask in enumerate(self.masks):
            own = seeds(tokens, mask, m)
            at = np.flatnonzero(self.low[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
            begin = np.searchsorted(self.hashes, own[at])
            end = np.searchsorted(self.hashes, own[at], side="right")
            reps = end - begin
            hit = np.repeat(begin, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            yield self.item[hit], np.repeat(at, reps) - self.place[hit]


    def short_items(self, tokens: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, item id) of every short item that stands in a document word for word."""
        for n, (hashes, item, words) in self.short.items():
            own = seeds(tokens, range(n), -n)
            at = np.flatnonzero(doc[: len(own)] == doc[n - 1:])
            begin = np.searchsorted(hashes, own[at])
            reps = np.searchsorted(hashes, own[at], side="right") - begin
            hit = np.repeat(begin, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            at = np.repeat(at, reps)
            same = np.ones(len(at), dtype=bool)
            for k in range(n):
                same &= tokens[at + k] == words[hit, k]
            yield doc[at[same]], item[hit[same]]


def overlap(document: np.ndarray, item: np.ndarray, offset: int, stretch: int, agree: float) -> int:
    """Agreeing tokens of the best stretch on one alignment, 0 if none agrees enough."""
    begin, end = max(0, -offset), min(len(item), len(document) - offset)
    width = min(stretch, len(item))
    if end - begin < width:
        return 0
    same = np.concatenate([[0], np.cumsum(document[begin + offset: end + offset] == item[begin:end])])
    best = int((same[width:] - same[:-width]).max())
    return best if best >= agree * width else 0


def _verdicts(texts: pa.Array, index: Index, stretch: int, agree: float) -> Iterator[tuple[list[dict], list[set]]]:
    """Items with their largest overlap, and short items, of some texts at a time, in order."""
    for piece in lexed(texts):
        found = [np.stack(pair, axis=1) for pair in index.alignments(piece.word)]
        pairs = np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=0)
        cut = np.searchsorted(piece.doc, np.arange(len(piece.rows) + 1))
        hits: list[dict] = [{} for _ in piece.rows]
        short: list[set] = [set() for _ in piece.rows]
        # An alignment may touch the documents beside the one it lies in.
        for item, offset in pairs.tolist():
            first = int(piece.doc[max(0, offset)])
            last = int(piece.doc[min(len(piece.doc), offset + len(index.items[item])) - 1])
            for d in range(first, last + 1):
                words = piece.word[cut[d]:cut[d + 1]]
                n = overlap(words, index.items[item], offset - int(cut[d]), stretch, agree)
                if n:
                    hits[d][index.ids[item]] = max(n, hits[d].get(index.ids[item], 0))
        for d, item in index.short_items(piece.word, piece.doc):
            for a, b in zip(d.tolist(), item.tolist()):
                short[a].add(b)
        yield hits, short


def _judged(docs: DataFrame, index: Index, stretch: int, agree: float) -> DataFrame:
    def judge(batches):
        for batch in batches:
            at = 0
            for hits, short in _verdicts(batch.column("text"), index, stretch, agree):
                rows, at = batch.slice(at, len(hits)), at + len(hits)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    rows.column("row"), pa.array([sorted(h) for h in hits], kind),
                    pa.array([max(h.values(), default=0) for h in hits], pa.int32()),
                    pa.array([sorted(x) for x in short], kind)], names=["row", "items", "agreeing", "short"])

    return docs.mapInArrow(judge, "row long, items array<bigint>, agreeing int, short array<bigint>")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Test items in blocks; no more than one block is in the driver's memory."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        size = len(row[1] or "")
        if ids and held + size > block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += size
    if ids:
        yield ids, texts


def contaminated(
    docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, agree: float = AGREE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, item_ids, agreeing, kept, short_item_ids`` for every row of ``docs``.

    A document is contaminated (not kept) when on some alignment with a test item a
    stretch of ``stretch`` tokens (of the whole item, if shorter) agrees in
    ``agree`` of them. ``agreeing`` is the largest such count, 0 without one.
    Tokens are lower-case runs of letters and digits. Items with under eight tokens do not
    contaminate; those that stand in the document word for word are ``short_item_ids``. Null texts and items
    without tokens match nothing; a null item_id is not listed but counts.
    Repeated rows and items, and empty tables, are fine. Other columns are ignored. A text of
    any length is compared whole, in the memory of one task (some 50 bytes a byte of text).
    """
    need(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    none = F.array().cast("array<bigint>")
    parts = [_judged(rows, index, stretch, agree) for index in _indexes(benchmark, block_bytes)]
    if not parts:
        judged = rows.select("row", none.alias("items"), F.lit(0).alias("agreeing"), none.alias("short"))
    elif len(parts) == 1:
        judged = parts[0]
    else:
        # Only rows with hits of a block matter, and they are few per document.
        united = reduce(DataFrame.unionByName, [written(p.filter("agreeing > 0 OR size(short) > 0")) for p in parts])
        best = united.groupBy("row").agg(
            *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "short")],
            F.max("agreeing").alias("agreeing"))
        judged = rows.select("row").join(best.withColumnRenamed("row", "hit"), F.col("row").eqNullSafe(F.col("hit")), "left").select(
            "row", *[F.coalesce(c, none).alias(c) for c in ("items", "short")], F.coalesce("agreeing", F.lit(0)).alias("agreeing"))
    return judged.select(
        F.col("row").alias("doc_id"), F.filter("items", lambda i: i >= 0).alias("item_ids"), "agreeing",
        (F.col("agreeing") == 0).alias("kept"), F.filter("short", lambda i: i >= 0).alias("short_item_ids"))


def _indexes(benchmark: DataFrame, block_bytes: int) -> Iterator[Index]:
    need(benchmark, "item_id", "text")
    for ids, texts in _blocks(benchmark, block_bytes):
        yield Index([-1 if i is None else i for i in ids], texts)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, agree: float = AGREE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without its contaminated rows; columns are those of ``docs``.

    Every row is judged by its own text, in the task that reads it; rows do not move.
    """
    need(docs, "doc_id", "text")
    for index in _indexes(benchmark, block_bytes):
        docs = _without(docs, index, stretch, agree)
    return docs


def _without(docs: DataFrame, index: Index, stretch: int, agree: float) -> DataFrame:
    def keep(batches):
        for batch in batches:
            clean = [not h for hits, _ in _verdicts(batch.column("text"), index, stretch, agree) for h in hits]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
