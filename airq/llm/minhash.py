"""MinHash near-duplicates by fast similarity sketching.

A sketch fills its coordinates in rounds: a round throws every shingle into a hashed
bin, where the least value stays, and values of later rounds are larger than all of
earlier ones. When half of the rounds have not reached every bin, each of the others
goes to one bin with all shingles, so that no coordinate stays empty. Coordinates of two sets agree with
the chance of their similarity, and their agreement is as concentrated as that of independent
hashes, at the price of a few passes over the set.

Texts with equal sets form a class first. Classes whose sketches agree in a whole
band meet in a bucket and are linked to its least member, which gives blocks: links can
only lie inside one. Every member's full set is sent once to the task of its block,
where members are compared set by set, those with the most company first; what is
linked already is not compared again. A block beyond what a task should hold is
compared with its most central member first; then only members of buckets that still hold
unlinked ones stay, and what is too large even then is compared in parts, two parts a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airq.llm.components import components
from airq.llm.rolling import MASK, SPACE, mix, prefix, spans
from airq.llm.shared import need, text_or_empty, written

WIDTH, PERCENT = 5, 85
#: Bands of a sketch and coordinates of a band. Sets of similarity 0.85 miss each other in all
#: of them with a chance of 3 in ten million.
BANDS, ROWS = 32, 6
#: Members and shingles of a block that one task compares.
MEMBERS, SHINGLES = 2000, 1 << 21
#: Bytes of text, and shingles, that are worked on at a time.
CHUNK, FLAT = 1 << 20, 1 << 20
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of each text as sorted 64-bit hashes of its distinct shingles."""
    at = 0
    while at < len(texts):
        bodies, held = [], 0
        while at < len(texts) and (not bodies or held < CHUNK):
            bodies.append((texts[at] or "").encode("utf-8", "surrogatepass").lower())
            held += len(bodies[-1])
            at += 1
        yield from _sets(bodies, width)


def _sets(bodies: list[bytes], width: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(bodies) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(b) + 1 for b in bodies])
    inside = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    low, high = edge[::2], edge[1::2]
    word = spans(prefix(data), low, high)
    cut = np.append(0, np.searchsorted(low, ends))
    # Each word is folded in on its own, so that the order of words matters throughout.
    full = np.full(max(0, len(word) - width + 1), width, dtype=np.uint64)
    for k in range(width):
        full = mix(full * _SPREAD + word[k: k + len(full)])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= width:
            yield np.unique(full[a: b - width + 1])
        else:
            one = np.full(min(1, b - a), b - a, dtype=np.uint64)
            for k in range(a, b):
                one = mix(one * _SPREAD + word[k])
            yield one


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per set; sets must not be empty."""
    n = len(sets)
    out = np.full((n, size), _FULL)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
    for turn in range(2 * size):
        if not len(flat):
            break
        hashed = mix(flat + np.uint64(int(_SPREAD) * (turn + 1) & MASK))
        if turn < size:
            place = ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = np.full(len(flat), turn - size)
        value = (np.uint64(turn) << np.uint64(50)) | (mix(hashed) >> np.uint64(14))
        np.minimum.at(out.reshape(-1), doc * size + place, value)
        # Filled sets leave; looking at each takes longer than a round of few shingles.
        if turn < 8 or turn % 8 == 7 or turn >= size:
            open_ = (out == _FULL).any(axis=1)[doc]
            if not open_.all():
                doc, flat = doc[open_], flat[open_]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = mix(key * _SPREAD + parts[:, :, r])
    return key.view(np.int64)


def _digest(own: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(own.tobytes())
    return ((d >> 64) ^ (1 << 63)) - (1 << 63), ((d & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63)


def marked(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, a, b, keys`` per row: size and digest of its set, keys of its bands.

    Sets too small to be that similar to another set have no keys.
    """
    def mark(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                            ("keys", pa.list_(pa.int64()))])

        def ready(ids, sets):
            digests = [_digest(s) if len(s) else (None, None) for s in sets]
            large = [i for i, s in enumerate(sets) if 100 * len(s) >= percent * (len(s) + 1)]
            keys: list = [None] * len(sets)
            for i, own in zip(large, band_keys(sketches([sets[i] for i in large], bands * rows), bands, rows)):
                keys[i] = own
            return pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                pa.array([d[1] for d in digests], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            held, first, size = [], 0, 0
            for own in shingle_sets(batch.column("text").to_pylist(), width):
                held.append(own)
                size += len(own)
                if size >= FLAT:
                    yield ready(batch.column("doc_id").slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
            yield ready(batch.column("doc_id").slice(first, len(held)), held)

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_.mapInArrow(mark, "doc_id long, n_shingles long, a long, b long, keys array<bigint>")


def _member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` with ``shingles``: the full set of each, taken from one of its texts."""
    schema = "id long, block long, large boolean, company long, shingles binary"
    names = ["id", "block", "large", "company"]

    def attached(batches):
        for batch in batches:
            wanted = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            rows, sets = [], []
            for i, own in enumerate(shingle_sets(batch.column("text").to_pylist(), width)):
                if len(own) and _digest(own) == wanted[i]:
                    rows.append(i)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n).take(pa.array(rows, pa.int64())) for n in names], pa.array(sets, pa.binary())],
                names=[*names, "shingles"])

    def bare(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").to_pylist(), width))
            digests = [_digest(s) for s in sets]
            yield pa.record_batch({"a": pa.array([d[0] for d in digests], pa.int64()), "b": pa.array([d[1] for d in digests], pa.int64()),
                                   "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = texts.filter("doc_id IS NOT NULL").join(members, F.col("doc_id") == F.col("least")).select(*names, "a", "b", "text")
    # Classes without any doc_id are found by the digest of their set.
    nameless = texts.filter("doc_id IS NULL").select("text").mapInArrow(bare, "a long, b long, shingles binary").join(
        members.filter("least IS NULL"), ["a", "b"]).select(*names, "shingles")
    return named.mapInArrow(attached, schema).unionByName(nameless)


def links_within(
    sets: list[np.ndarray], company: np.ndarray, label: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Pairs of a block that are similar enough, as many as connect all such pairs.

    Members go one by one, those with the most company first, and are compared with all that come later
    and have another label; links merge labels. With ``side``, only members of different sides are.
    """
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) > 2 else None
    if code is None:
        n = len(np.intersect1d(*sets, assume_unique=True))
        apart = label[0] != label[1] and (side is None or side[0] != side[1])
        return [(0, 1)] if apart and 100 * n >= percent * (size.sum() - n) else []
    start = np.cumsum(size) - size
    held = np.zeros(int(code.max()) + 1, dtype=bool)
    label, waiting, found = label.copy(), np.ones(len(sets), dtype=bool), []
    for p in np.argsort(-company, kind="stable").tolist():
        waiting[p] = False
        near = waiting & (label != label[p]) & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p]))
        if side is not None:
            near &= side != side[p]
        other = np.flatnonzero(near)
        if not len(other):
            continue
        own = code[start[p]: start[p] + size[p]]
        held[own] = True
        n = size[other]
        at = np.cumsum(n) - n
        flat = np.arange(int(n.sum())) + np.repeat(start[other] - at, n)
        common = np.add.reduceat(held[code[flat]].astype(np.int64), at)
        held[own] = False
        linked = other[100 * common >= percent * (size[p] + n - common)]
        if len(linked):
            found += [(p, q) for q in linked.tolist()]
            label[np.isin(label, label[linked])] = label[p]
    return found


def _compared(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links ``u, v`` of groups of rows ``by, id, label, side, company, shingles``."""
    def compare(batches):
        key, held = None, {}

        def links():
            ids = list(held)
            if len(ids) < 2:
                return
            label, side, company, sets = zip(*held.values())
            pairs = links_within([np.frombuffer(s, dtype=np.uint64) for s in sets], np.array(company), np.array(label),
                                 np.array(side) if by[1:] and key[1] != key[2] else None, percent)
            if pairs:
                yield pa.record_batch({"u": pa.array([ids[p] for p, _ in pairs]), "v": pa.array([ids[q] for _, q in pairs])})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in by]
            values = zip(*[batch.column(c).to_pylist() for c in ("id", "label", "side", "company", "shingles")])
            for own, (i, *rest) in zip(zip(*columns), values):
                if own != key:
                    yield from links()
                    key, held = own, {}
                held[i] = rest
        yield from links()

    dealt = rows.repartition(*by).sortWithinPartitions(*by, "id")
    return dealt.select(*by, "id", "label", "side", "company", "shingles").mapInArrow(compare, "u long, v long")


def _central(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` of every row with the member of its block that has the most company."""
    best = rows.groupBy("block").agg(F.max(F.struct("company", "id")).alias("best")).select("best.id", F.col("block").alias("of"))
    hubs = written(best.join(rows, "id").dropDuplicates(["id"]).select("of", F.col("id").alias("hub"), F.col("shingles").alias("center")))

    def compare(batches):
        for batch in batches:
            u, v = [], []
            for i, hub, one, two in zip(*[batch.column(c).to_pylist() for c in ("id", "hub", "shingles", "center")]):
                a, b = np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True))
                if i != hub and 100 * n >= percent * (len(a) + len(b) - n):
                    u.append(i)
                    v.append(hub)
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.join(hubs, F.col("block") == F.col("of")).select("id", "hub", "shingles", "center").mapInArrow(compare, "u long, v long")


def _blocks(met: DataFrame) -> DataFrame:
    """``id, block`` of all that meet: ``met`` has ``id, head`` per member of a bucket."""
    found = components(met.select(F.col("id").alias("u"), F.col("head").alias("v")))
    return found.select(F.col("u").alias("id"), F.col("v").alias("block")).unionByName(
        found.select(F.col("v").alias("id"), F.col("v").alias("block")).distinct())


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int, most: int, shingles: int) -> DataFrame:
    """Links ``u, v`` of class numbers that connect all similar classes."""
    rows = classes.filter("keys IS NOT NULL").select("id", F.posexplode("keys").alias("band", "key"))
    heads = written(rows.groupBy("band", "key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("held")).filter("held > 1"))
    met = written(rows.join(heads, ["band", "key"]))
    blocks = written(_blocks(met).join(met.groupBy("id").agg(F.sum("held").alias("company")), "id").join(
        classes.select("id", "least", "n_shingles", "a", "b"), "id"))

    def too_large(frame):
        sums = frame.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total"))
        return sums.filter((F.col("members") > most) | (F.col("total") > shingles))

    large = written(too_large(blocks).select("block", F.lit(True).alias("large")))
    members = blocks.join(large, "block", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    sets = written(_member_sets(docs, members, width))
    apart = [F.col("id").alias("label"), F.lit(0).alias("side")]
    links = written(_compared(sets.filter("NOT large").select("*", *apart), ["block"], percent))
    if large.isEmpty():
        return links

    # Large blocks: their center first, then buckets that still hold unlinked members.
    big = sets.filter("large")
    first = written(_central(big, percent))
    label = first.select(F.col("u").alias("id"), F.col("v").alias("label"))
    labelled = written(blocks.join(large, "block").join(label, "id", "left").select(
        "id", "block", "n_shingles", F.coalesce("label", "id").alias("label")))
    open_ = met.join(labelled.select("id", "label"), "id").groupBy("band", "key").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band", "key")
    still = written(met.join(written(open_), ["band", "key"]).select("id").distinct())
    again = written(labelled.join(still, "id"))
    parts = too_large(again).selectExpr("block", f"CAST(ceil(greatest(members / {most}D, total / {shingles}D)) * 2 AS INT) AS parts")
    dealt = again.join(written(parts), "block", "left").select(
        "id", "block", "label", F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("side"))
    # Every two parts meet in one task; all parts but of the largest blocks are one.
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "id", "block", "label", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"))
    with_sets = written(pairs).join(big.select("id", "company", "shingles").dropDuplicates(["id"]), "id")
    rest = written(_compared(with_sets, ["block", "one", "two"], percent))
    return links.unionByName(first).unionByName(rest)


def minhash_groups(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    most: int = MEMBERS, shingles: int = SHINGLES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A document's set are its distinct shingles of ``width`` words (A-Z lower-cased, words end at ASCII white
    space); fewer words are one shingle, and without words the set is empty and
    linked with nothing. Documents link when their sets share ``percent`` of what they have together;
    ``component_id`` is the least doc_id reachable over links, ``kept`` that the document is
    that one. Links are confirmed on full sets, whose shingles are 64-bit hashes. Null texts
    have no words. A null doc_id never names a component that has another id. Repeated rows
    stay and share a component; an empty table gives no rows; other columns are ignored. A text of any length is one set in one task.
    """
    need(docs, "doc_id", "text")
    own = written(marked(docs.select("doc_id", text_or_empty().alias("text")), width, percent, bands, rows))
    classes = own.filter("n_shingles > 0").groupBy("a", "b").agg(
        F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    roots = components(_links(docs, classes, width, percent, most, shingles)).select(
        F.col("u").alias("id"), F.col("v").alias("root"))
    rooted = written(classes.select("id", "a", "b", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_set = written(rooted.join(named, "root").select("a", "b", "component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", "a", "b").join(of_set, ["a", "b"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
