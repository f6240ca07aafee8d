"""Repeated windows of a corpus, found by super-k-mers that travel to their minimiser's bucket.

A window is ``width`` consecutive units (bytes or words) of one document. Its
minimiser is the least hash of the ``gram``-unit pieces in it, so equal windows have
equal minimisers. Consecutive windows with one minimiser form a super-k-mer: one
packed string that travels to the bucket of that minimiser.

Documents are dealt into parts by a hash of id and text. Three exchanges follow:

1. Each part sends its distinct minimisers to their buckets and gets back those
   that occur in more than one document. The others' windows cannot repeat.
2. Each part sends its distinct super-k-mers of those, each once with the least
   and greatest id that has it, and gets back, per super-k-mer, the runs of its windows
   whose least id in the corpus is below that greatest id.
3. Each part marks, in every document, the windows that a smaller id owns.

A minimiser that very many parts or windows share would crowd its bucket. Its
super-k-mers are cut into single windows, which travel by a hash of the whole window
instead; equal windows still meet, because being crowded is a property of
the minimiser in the whole corpus. A passage that a third of all documents
share is one string per part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from airq.llm.rolling import grams, mix, prefix, run_starts, sliding_min, spans
from airq.llm.shared import NO_ID, need, packed, text_or_empty, unpacked

#: Bytes of text that are hashed at a time, about 50 bytes of memory each; what is made of them fits a core's cache.
CHUNK = 1 << 18
#: Text bytes of a part. A part's text, and the strings it sends, are in one task's memory. Parts send to all
#: buckets, of which there are as many, so payloads grow with the square of parts: they are few and large.
PART_BYTES = 12 << 20
#: A small corpus is dealt into up to so many parts, of so many bytes at least, to keep all cores busy.
FEW_PARTS, FEW_BYTES = 64, 4 << 20
#: Bytes of a bucket's strings whose windows are put in order at a time.
SLICE = 2 << 20
#: Super-k-mers of one minimiser, over all parts, above which it counts as crowded.
CROWDED = 20_000


class Units(NamedTuple):
    """What a window is made of, and when two documents share one."""

    words: bool
    width: int
    gram: int


class Chunk(NamedTuple):
    """Some documents as one buffer; ``low`` and ``high`` are the bytes of each unit."""

    buffer: bytes
    codes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def chunk_of(bodies: list[bytes], first: int, words: bool) -> Chunk:
    """Units of ``bodies``; words are joined by single spaces."""
    if not words:
        buffer = b"".join(bodies)
        codes = np.frombuffer(buffer, dtype=np.uint8)
        at = np.arange(len(codes))
        doc = np.repeat(np.arange(first, first + len(bodies)), [len(b) for b in bodies])
        return Chunk(buffer, codes, at, at + 1, doc)
    lines = [b" ".join(b.split()) for b in bodies]
    which = [i for i, line in enumerate(lines) if line]
    buffer = b" ".join(lines[i] for i in which)
    codes = np.frombuffer(buffer, dtype=np.uint8)
    gaps = np.flatnonzero(codes == 0x20)
    if not len(codes):
        none = np.zeros(0, dtype=np.int64)
        return Chunk(b"", none.astype(np.uint64), none, none, none)
    low = np.concatenate([[0], gaps + 1])
    high = np.concatenate([gaps, [len(codes)]])
    doc = np.repeat(np.array(which) + first, [lines[i].count(b" ") + 1 for i in which])
    return Chunk(buffer, spans(prefix(codes), low, high), low, high, doc)


def chunk_slices(bodies: list[bytes], size: int = CHUNK) -> Iterator[slice]:
    """Stretches of ``bodies`` of about ``size`` bytes."""
    start, held = 0, 0
    for i, body in enumerate(bodies):
        if held and held + len(body) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(body)
    if start < len(bodies):
        yield slice(start, len(bodies))


def chunks_of(bodies: list[bytes], words: bool, size: int = CHUNK) -> Iterator[Chunk]:
    for at in chunk_slices(bodies, size):
        yield chunk_of(bodies[at], at.start, words)


def super_kmers(chunk: Chunk, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer."""
    least = sliding_min(grams(chunk.codes, units.gram), units.width - units.gram + 1)
    n = len(least)
    owner = chunk.doc[:n]
    whole = owner == chunk.doc[units.width - 1: units.width - 1 + n]
    first = run_starts(least, owner, whole)
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, n))
    good = whole[at]
    return at[good], count[good], least[at[good]]


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a part in an order that does not depend on how rows arrived."""
    ids = table["doc_id"].to_numpy()
    bodies = [t.as_py().encode("utf-8", "surrogatepass") for t in table["text"]]
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], bodies[i])))
    return ids[order], [bodies[i] for i in order]


def _nameless(table: pa.Table, ids: np.ndarray) -> np.ndarray:
    """Which of the ordered ids stand for none. Rows that share the largest id are in order of their texts."""
    top = ids == NO_ID
    if top.any():
        rows = zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["no_id"].to_pylist())
        top[top] = [flag for _, flag in sorted((t.encode("utf-8", "surrogatepass"), flag) for i, t, flag in rows if i == NO_ID)]
    return top


def _minimisers(table: pa.Table, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct minimisers of a part, their super-k-mers, and whether two ids have one."""
    ids, bodies = _ordered(table)
    marks, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for chunk in chunks_of(bodies, units.words):
        at, _, mark = super_kmers(chunk, units)
        marks.append(mark)
        owners.append(ids[chunk.doc[at]])
    mark, owner = np.concatenate(marks), np.concatenate(owners)
    order = np.argsort(mark, kind="stable")
    mark, owner = mark[order], owner[order]
    starts = np.flatnonzero(run_starts(mark))
    if not len(starts):
        return mark, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
    several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
    return mark[starts], np.diff(np.append(starts, len(mark))).astype(np.uint32), several


def _shared(parts: list[int], sets: list[tuple], crowded: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per part: its minimisers that several documents have, and which are crowded."""
    mark = np.concatenate([s[0] for s in sets])
    part = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    count = np.concatenate([s[1] for s in sets]).astype(np.int64)
    several = np.concatenate([s[2] for s in sets])
    order = np.argsort(mark, kind="stable")
    mark, part, count, several = mark[order], part[order], count[order], several[order]
    first = run_starts(mark)
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.append(starts, len(mark)))
    shared = (size > 1) | np.logical_or.reduceat(several, starts)
    full = np.add.reduceat(count, starts) > crowded
    keep = shared[group]
    order = np.argsort(part[keep], kind="stable")
    mark, part, full = mark[keep][order], part[keep][order], full[group][keep][order]
    for at in np.split(np.arange(len(part)), np.flatnonzero(run_starts(part))[1:]) if len(part) else []:
        yield parts[part[at[0]]], mark[at], full[at]


class Strings(NamedTuple):
    """Distinct super-k-mers of a part and where they occur."""

    bodies: list[bytes]
    windows: np.ndarray
    buckets: np.ndarray
    slices: np.ndarray  # 16 bits that strings with a common window have in common
    least: np.ndarray
    most: np.ndarray
    occurrence: np.ndarray  # rows of string, document, first window (unit in the document)


def _strings(ids, bodies, units: Units, marks: np.ndarray, full: np.ndarray, n_buckets: int) -> Strings:
    """Super-k-mers whose minimiser is in ``marks`` (ascending)."""
    known: dict[bytes, int] = {}
    windows, hashes, occurrence, n = [], [], [], units.width
    for chunk in chunks_of(bodies, units.words):
        at, count, mark = super_kmers(chunk, units)
        place = np.searchsorted(marks, mark)
        place[place == len(marks)] = 0
        hit = np.flatnonzero(marks[place] == mark) if len(marks) else np.zeros(0, dtype=int)
        at, count, mark, crowd = at[hit], count[hit], mark[hit], full[place[hit]]
        if crowd.any():
            reps = np.where(crowd, count, 1)
            at = np.repeat(at, reps) + np.where(np.repeat(crowd, reps), np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps), 0)
            count, mark, crowd = np.where(np.repeat(crowd, reps), 1, np.repeat(count, reps)), np.repeat(mark, reps), np.repeat(crowd, reps)
        if not len(at):
            continue
        docs = chunk.doc[at]
        base = np.searchsorted(chunk.doc, docs)  # first unit of the document
        buffer, before = chunk.buffer, len(known)
        own = [buffer[a:b] for a, b in zip(chunk.low[at].tolist(), chunk.high[at + count + n - 2].tolist())]
        sid = np.array([known.setdefault(body, len(known)) for body in own])
        occurrence.append(np.stack([sid, docs, at - base], axis=1))
        new, first = np.unique(sid, return_index=True)
        first = first[new >= before]  # in order of their numbers, as numbers are given in order of appearance
        if len(first):
            crowd, hashed = crowd[first], mix(mark[first])
            whole = np.array([zlib.crc32(own[i]) for i in first[crowd].tolist()], dtype=np.uint64)
            hashed[crowd] = mix(whole)
            windows.append(count[first])
            hashes.append(hashed)
    if not occurrence:
        none = np.zeros(0, dtype=np.int64)
        return Strings([], none, none, none.astype(np.uint16), none, none, np.zeros((0, 3), dtype=np.int64))
    occurrence, hashed = np.concatenate(occurrence), np.concatenate(hashes)
    least = np.full(len(known), NO_ID)
    most = np.full(len(known), np.iinfo(np.int64).min)
    owner = ids[occurrence[:, 1]]
    np.minimum.at(least, occurrence[:, 0], owner)
    np.maximum.at(most, occurrence[:, 0], owner)
    buckets = (hashed % np.uint64(n_buckets)).astype(np.int64)
    return Strings(list(known), np.concatenate(windows), buckets, (hashed >> np.uint64(48)).astype(np.uint16), least, most, occurrence)


#: Distinct strings and how many windows each has, to a class number for every window.
Classes = Callable[[list[bytes], np.ndarray], np.ndarray]


def _labels(strings: list[bytes], n_windows: np.ndarray, slices: np.ndarray, classes: Classes, size: int = SLICE) -> np.ndarray:
    """``classes`` of the strings, a slice at a time; strings of two slices have no window in common."""
    n_slices = -(-sum(map(len, strings)) // size)
    if n_slices < 2:
        return classes(strings, n_windows)
    which = slices.astype(np.int64) * n_slices >> 16
    label = np.zeros(n_windows.sum(), dtype=np.int64)
    place, order = np.cumsum(n_windows) - n_windows, np.argsort(which, kind="stable")
    number = 0
    for own in np.split(order, np.flatnonzero(run_starts(which[order]))[1:]):
        n = n_windows[own]
        found = classes([strings[i] for i in own.tolist()], n)
        if len(found):
            label[np.repeat(place[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = found + number
            number += int(found.max()) + 1
    return label


def _owned(rows: list[tuple], classes: Classes) -> Iterator[tuple[int, list]]:
    """Per part: runs (string, first window, windows, owner) that a smaller id owns."""
    if not rows:
        return
    known: dict[bytes, int] = {}
    own = []
    for _, (*_, body, ends) in rows:
        ends = ends.tolist()
        own += [known.setdefault(body[a:b], len(known)) for a, b in zip([0, *ends], ends)]
    own = np.array(own, dtype=np.int64)
    sids, windows, slices, least, most = (np.concatenate([payload[i] for _, payload in rows]) for i in range(5))
    sender = np.repeat(np.arange(len(rows)), [len(payload[0]) for _, payload in rows])
    n_windows, slice_of = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.uint16)
    n_windows[own], slice_of[own] = windows, slices
    floor = np.full(len(known), NO_ID)
    np.minimum.at(floor, own, least)
    label = _labels(list(known), n_windows, slice_of, classes)
    n_labels = int(label.max()) + 1 if len(label) else 0
    owner = np.full(n_labels, NO_ID)
    np.minimum.at(owner, label, np.repeat(floor, n_windows))
    owner = owner[label]
    string = np.repeat(np.arange(len(known)), n_windows)
    starts = np.flatnonzero(run_starts(owner, string))
    count = np.diff(np.append(starts, len(owner)))
    begin = np.cumsum(n_windows) - n_windows
    # Runs of a string lie side by side.
    run_from = np.searchsorted(string[starts], np.arange(len(known)))
    run_to = np.searchsorted(string[starts], np.arange(len(known)), side="right")
    reps = run_to[own] - run_from[own]
    run = np.repeat(run_from[own], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    useful = owner[starts[run]] < np.repeat(most, reps)
    run, sids, sender = run[useful], np.repeat(sids, reps)[useful], np.repeat(sender, reps)[useful]
    offset = starts[run] - begin[string[starts[run]]]
    found = [sids.astype(np.int32), offset.astype(np.int32), count[run].astype(np.int32), owner[starts[run]]]
    heads = np.flatnonzero(run_starts(sender)).tolist()
    for a, b in zip(heads, [*heads[1:], len(sender)]):
        yield rows[sender[a]][0], [column[a:b] for column in found]


def covered_units(n_units: int, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the units in any of ``counts`` windows that begin at ``starts``."""
    change = np.zeros(n_units + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + width - 1, -1)
    return np.cumsum(change[:-1]) > 0


def parts_of(size: int) -> int:
    """Parts that ``size`` bytes of text are dealt into."""
    return max(-(-size // PART_BYTES), min(-(-size // FEW_BYTES), FEW_PARTS))


def remove_repeats(
    docs: DataFrame, units: Units, classes: Classes, finish: Callable[[bytes, np.ndarray], tuple],
    schema: str, parts: int | None = None, crowded: int = CROWDED,
) -> DataFrame:
    """``doc_id`` and what ``finish`` makes of each text and its mask of units to remove.

    A unit goes when a window that covers it also starts in a document with a
    smaller doc_id. A null text is empty. Null ids sort last and count as one id, that of the
    largest long; rows with one id do not remove each other's text. ``parts`` is how many
    parts the corpus is dealt into; a part's text is in one task's memory, so it follows the bytes of
    text by default (see ``parts_of``). A single text is never cut and takes some 50 times its bytes there.
    """
    need(docs, "doc_id", "text")
    parts = parts or parts_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1)
    ids = F.col("doc_id").cast("long")
    dealt = docs.select(
        F.coalesce(ids, F.lit(NO_ID)).alias("doc_id"), ids.isNull().alias("no_id"), text_or_empty().alias("text"),
        F.pmod(F.xxhash64(ids, "text"), F.lit(parts)).cast("int").alias("part"))

    def ask(key, table):
        mark, count, several = _minimisers(table, units)
        to = (mix(mark) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, mark, count, several = to[order], mark[order], count[order], several[order]
        starts = np.flatnonzero(run_starts(to))
        pieces = np.split(np.arange(len(to)), starts[1:]) if len(to) else []
        return pa.table({
            "bucket": pa.array(to[starts], pa.int32()), "part": pa.array([key[0].as_py()] * len(starts), pa.int32()),
            "payload": pa.array([packed(mark[p], count[p], several[p]) for p in pieces], pa.binary())})

    def answer(key, table):
        sets = [unpacked(p.as_py()) for p in table["payload"]]
        found = list(_shared(table["part"].to_pylist(), sets, crowded))
        return pa.table({
            "part": pa.array([f[0] for f in found], pa.int32()), "kind": pa.array([0] * len(found), pa.int32()),
            "payload": pa.array([packed(f[1], f[2]) for f in found], pa.binary())})

    def merged_marks(payloads):
        marks = np.concatenate([np.zeros(0, dtype=np.uint64), *[p[0] for p in payloads]])
        full = np.concatenate([np.zeros(0, dtype=bool), *[p[1] for p in payloads]])
        order = np.argsort(marks)
        return marks[order], full[order]

    def send(key, table, marks):
        ids, bodies = _ordered(table)
        s = _strings(ids, bodies, units, *merged_marks([unpacked(p.as_py()) for p in marks["payload"]]), parts)
        to, out = s.buckets, []
        order = np.argsort(to, kind="stable")
        starts = np.flatnonzero(run_starts(to[order]))
        windows = s.windows.astype(np.int32)
        for piece in np.split(order, starts[1:]) if len(order) else []:
            own = [s.bodies[i] for i in piece.tolist()]
            out.append(packed(piece.astype(np.int32), windows[piece], s.slices[piece], s.least[piece], s.most[piece],
                              b"".join(own), np.cumsum([len(b) for b in own])))
        return pa.table({
            "bucket": pa.array(to[order][starts], pa.int32()), "part": pa.array([key[0].as_py()] * len(out), pa.int32()),
            "payload": pa.array(out, pa.binary())})

    def judge(key, table):
        rows = [(part, unpacked(p.as_py())) for part, p in zip(table["part"].to_pylist(), table["payload"])]
        rows.sort(key=lambda r: r[0])
        found = list(_owned(rows, classes))
        return pa.table({
            "part": pa.array([f[0] for f in found], pa.int32()), "kind": pa.array([1] * len(found), pa.int32()),
            "payload": pa.array([packed(*f[1]) for f in found], pa.binary())})

    def mark(key, table, told):
        ids, bodies = _ordered(table)
        if not len(ids):
            return pa.Table.from_batches([], out_schema)
        kinds = [(k, unpacked(p.as_py())) for k, p in zip(told["kind"].to_pylist(), told["payload"])]
        s = _strings(ids, bodies, units, *merged_marks([p for k, p in kinds if k == 0]), parts)
        runs = [p for k, p in kinds if k == 1]
        spans_of: list[list] = [[] for _ in bodies]
        if runs and len(s.occurrence):
            sid, offset, count, owner = (np.concatenate([r[i] for r in runs]) for i in range(4))
            order = np.argsort(sid, kind="stable")
            sid, offset, count, owner = sid[order], offset[order], count[order], owner[order]
            own = s.occurrence
            begin, end = np.searchsorted(sid, own[:, 0]), np.searchsorted(sid, own[:, 0], side="right")
            reps = end - begin
            run = np.repeat(begin, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            doc, window = np.repeat(own[:, 1], reps), np.repeat(own[:, 2], reps)
            hit = owner[run] < ids[doc]
            run, doc, window = run[hit], doc[hit], window[hit]
            order = np.argsort(doc, kind="stable")
            run, doc, window = run[order], doc[order], window[order]
            for at in np.split(np.arange(len(doc)), np.flatnonzero(run_starts(doc))[1:]) if len(doc) else []:
                spans_of[doc[at[0]]] = [window[at] + offset[run[at]], count[run[at]].astype(np.int64)]
        made = []
        for body, own in zip(bodies, spans_of):
            n_units = len(body.split()) if units.words else len(body)
            gone = covered_units(n_units, *own, units.width) if own else np.zeros(n_units, dtype=bool)
            made.append(finish(body, gone))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*made), list(out_schema)[1:])]
        return pa.Table.from_arrays([pa.array(ids, mask=_nameless(table, ids)), *columns], schema=out_schema)

    out_type = StructType.fromDDL(f"doc_id long, {schema}")
    out_schema = to_arrow_schema(out_type)
    texts = dealt.select("part", "doc_id", "no_id", "text")
    asked = texts.groupBy("part").applyInArrow(ask, "bucket int, part int, payload binary")
    flags = asked.groupBy("bucket").applyInArrow(answer, "part int, kind int, payload binary")
    sent = texts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(send, "bucket int, part int, payload binary")
    owned = sent.groupBy("bucket").applyInArrow(judge, "part int, kind int, payload binary")
    told = flags.unionByName(owned)
    return texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(mark, out_type)


def window_classes(units: Units) -> Classes:
    """Equal windows get equal numbers: windows are sorted by hash, then compared byte by byte."""

    def classes(strings: list[bytes], n_windows: np.ndarray) -> np.ndarray:
        if not strings:
            return np.zeros(0, dtype=np.int64)
        chunk = chunk_of(strings, 0, units.words)
        first = np.searchsorted(chunk.doc, np.arange(len(strings)))
        at = np.repeat(first, n_windows) + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        low, high = chunk.low[at], chunk.high[at + units.width - 1]
        digest = spans(prefix(chunk.codes), at, at + units.width)
        order = np.argsort(digest, kind="stable")
        low, high, digest = low[order], high[order], digest[order]
        same = (digest[1:] == digest[:-1]) & ((high - low)[1:] == (high - low)[:-1])
        pairs = np.flatnonzero(same)
        data = np.frombuffer(chunk.buffer + b"\0" * 8, dtype=np.uint8)
        words8 = np.lib.stride_tricks.sliding_window_view(data, 8)
        a, b, size = low[pairs], low[pairs + 1], (high - low)[pairs]
        equal = np.ones(len(pairs), dtype=bool)
        for step in range(0, int(size.max()) if len(size) else 0, 8):
            on = np.flatnonzero(step < size)
            # Words of eight bytes; the last one reaches back to the window's end.
            shift = np.minimum(step, np.maximum(size[on] - 8, 0))
            equal[on] &= (words8[a[on] + shift] == words8[b[on] + shift]).all(axis=1) | (size[on] < 8)
        short = np.flatnonzero(size < 8)
        for i in short.tolist():
            equal[i] = chunk.buffer[a[i]:a[i] + size[i]] == chunk.buffer[b[i]:b[i] + size[i]]
        joined = np.zeros(len(order), dtype=bool)
        joined[pairs + 1] = equal
        label = np.empty(len(order), dtype=np.int64)
        label[order] = np.cumsum(~joined) - 1
        if not equal.all():  # a hash collision: group that hash by its bytes
            seen: dict[bytes, int] = {}
            bad = np.isin(digest, digest[pairs[~equal]])
            for i in np.flatnonzero(bad).tolist():
                body = chunk.buffer[low[i]:high[i]]
                label[order[i]] = seen.setdefault(body, len(order) + len(seen))
        return label

    return classes
