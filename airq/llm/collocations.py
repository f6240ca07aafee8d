"""Phrase collocation mining with an FM-index per shard.

Tasks turn the texts they read into shards: per language, numbers of words with breaks
between pieces. Texts do not move. A shard's words are counted, and words that are frequent
over all shards get a number that all shards share. Then every shard's index lists its
phrases by interval extension: those of two frequent words, then, in the stretches where one
frequent pair follows the other, those of three, and in stretches of frequent triples all longer ones up to
the depth. Counts are summed across shards after each step; those of three words and more travel packed,
a shard's share of each part of all phrases in one row, and only what is frequent becomes rows. What a shard learns of the others comes to it by a
shuffle on the shard, restricted to what occurs in it, so nothing is broadcast.

An extension of a phrase that is as frequent as the phrase itself marks it as part of a longer one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airq.llm.fmindex import Index
from airq.llm.rolling import BASE, mix, run_starts
from airq.llm.shared import need, packed, partitions, unpacked, written

#: Words of a shard (its index takes some 60 bytes a word), and bytes of text taken at a time.
SHARD_WORDS, CHUNK = 3 << 20, 1 << 20
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Upper case down, separators to full stops, which become tokens of their own.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SEPARATORS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(SEPARATORS))
LEAST, DEPTH, FIRST = 100, 5, 2000

_SHARDS = "shard long, lang string, word binary, local int, n long, payload binary"


class _Shard:
    """Words of one language that a task has read so far."""

    def __init__(self):
        self.vocabulary: defaultdict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[b"."] = 0
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, plain: bytes) -> None:
        tokens = plain.replace(b".", b" . ").split()
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int32, len(tokens)))
        self.held += len(tokens)

    def rows(self, shard: int, lang: str):
        text = np.concatenate(self.parts)
        text = text[(text > 0) | np.append(True, text[:-1] > 0)]
        counts = np.bincount(text, minlength=len(self.vocabulary))
        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("local", pa.int32()),
                            ("n", pa.int64()), ("payload", pa.binary())])
        yield pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, "payload": packed(text)}], schema=schema)
        words = list(self.vocabulary)
        for a in range(1, len(words), 1 << 16):
            own = words[a:a + (1 << 16)]
            n = len(own)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, shard)), pa.array([lang] * n), pa.array(own, pa.binary()),
                pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(counts[a:a + n].astype(np.int64)),
                pa.nulls(n, pa.binary())], schema=schema)


def _cut(plain: bytes, size: int):
    """Pieces of about ``size`` bytes that end where a piece of the text ends."""
    at = 0
    while len(plain) - at > size:
        end = plain.rfind(b".", at + 1, at + size)
        if end < 0:
            end = plain.find(b".", at + size)
        if end < 0:
            break
        yield plain[at:end]
        at = end
    yield plain[at:]


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS, chunk: int = CHUNK) -> DataFrame:
    """Rows of two kinds per shard: its words (``word, local, n``), and its text (``payload``)."""
    need(docs, "text", "lang")

    def make(batches):
        held: dict[str, _Shard] = {}
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            waiting: dict[str, list[bytes]] = defaultdict(list)
            size: dict[str, int] = defaultdict(int)
            texts = batch.column("text").cast(pa.binary())
            for i, lang in enumerate([*batch.column("lang").to_pylist(), None]):
                last = i == batch.num_rows
                if not last:
                    text = texts[i].as_py() or b""
                    waiting[lang].append(text)
                    size[lang] += len(text) + 1
                for name in [n for n in size if last or size[n] > chunk]:
                    for part in _cut(b".".join(waiting.pop(name)).translate(_PLAIN), chunk):
                        own = held.setdefault(name, _Shard())
                        own.add(part + b".")
                        if own.held >= shard_words:
                            yield from held.pop(name).rows((task << 32) + made, name)
                            made += 1
                    del size[name]
        for name, own in held.items():
            yield from own.rows((task << 32) + made, name)
            made += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(make, _SHARDS).withColumn("uid", F.monotonically_increasing_id())


def _numbered(payload: bytes, local: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's text in dense numbers of its frequent words, 0 elsewhere; and their shared numbers."""
    (text,) = unpacked(payload)
    order = np.argsort(shared)
    dense = np.zeros(int(text.max(initial=0)) + 1, dtype=np.int32)
    dense[local[order]] = np.arange(1, len(local) + 1, dtype=np.int32)
    text = dense[text]
    # Only words beside another one can be part of a phrase.
    beside = np.zeros(len(text), dtype=bool)
    pair = (text[1:] > 0) & (text[:-1] > 0)
    beside[1:] |= pair
    beside[:-1] |= pair
    text = np.where(beside, text, 0)
    return text[(text > 0) | np.append(True, text[:-1] > 0)], np.concatenate([[-1], shared[order]])


def _held(text: np.ndarray, phrases: np.ndarray, base: int) -> np.ndarray:
    """Whether one of ``phrases`` (a row of words each) starts at each place of ``text``."""
    code, known = text.astype(np.int64), phrases[:, 0].astype(np.int64)
    for k in range(1, phrases.shape[1]):
        pairs, known = np.unique(known * base + phrases[:, k], return_inverse=True)
        key = code[:-1] * base + text[k:]
        at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
        found = (pairs[at] == key) if len(pairs) else np.zeros(len(key), dtype=bool)
        code = np.where(found & (code[:-1] >= 0), at, -1)
    return code >= 0


def _runs(text: np.ndarray, held: np.ndarray, length: int) -> np.ndarray:
    """The stretches of ``text`` in which a phrase of ``length`` words starts at one place after the other.

    Only stretches with room for a longer phrase; stretches may share words, longer phrases
    lie in one of them.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    first, end = first[end - first > 1], end[end - first > 1]
    size = end - first + length - 1
    at = np.cumsum(size + 1) - (size + 1)
    place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out = np.zeros(int(size.sum()) + len(size), dtype=np.int32)
    out[place] = text[place - np.repeat(at, size) + np.repeat(first, size)]
    return out


def _pairs(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``shard, first, second, n`` of all pairs of frequent words."""
    def count(left, right):
        if not left.num_rows or not right.num_rows:
            return _nothing(("shard", "first", "second", "n"))
        text, shared = _numbered(left["payload"][0].as_py(), right["local"].to_numpy(), right["gid"].to_numpy())
        index = Index(text, 1)
        found = index.left(index.single())
        n = len(found.count)
        return pa.table({"shard": np.full(n, left["shard"][0].as_py()), "first": shared[found.words[:, 0]],
                         "second": shared[found.words[:, 1]], "n": found.count.astype(np.int64)})

    return texts.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(
        count, "shard long, first long, second long, n long")


def _dealt(words: np.ndarray, parts: int) -> np.ndarray:
    """In which of ``parts`` each phrase (a row of words) is summed, in every shard the same."""
    found = np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        found = mix(found * np.uint64(BASE) + column.astype(np.uint64))
    return (found % np.uint64(parts)).astype(np.int64)


def _longer(texts: DataFrame, known: DataFrame, length: int, depth: int, parts: int) -> DataFrame:
    """``part, shard, payload`` of phrases of more than ``length`` and up to ``depth`` words, all of whose parts of
    ``length`` words are known; a payload has phrases of one size that are summed in ``part``, and their counts.

    ``known`` has per shard its words (``local``, one id) and phrases of that length (their ids).
    """
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])

    def count(left, right):
        out = []
        if left.num_rows and right.num_rows:
            single = right["local"].is_valid()
            words, phrases = right.filter(single), right.filter(pc.invert(single))
            text, shared = _numbered(left["payload"][0].as_py(), words["local"].to_numpy(), _flat(words["ids"]))
            # Every word of a phrase is frequent, so it has a number here.
            held = _held(text, np.searchsorted(shared, _flat(phrases["ids"])).reshape(-1, length), len(shared))
            index = Index(_runs(text, held, length), depth)
            found = index.left(index.single())
            for size in range(3, depth + 1):
                found = index.right(found) if size % 2 else index.left(found)
                if size > length:
                    ids = shared[found.words]
                    part = _dealt(ids, parts)
                    order = np.argsort(part, kind="stable")
                    at = np.flatnonzero(run_starts(part[order]))
                    for own in np.split(order, at[1:]) if len(at) else ():
                        out.append({"part": int(part[own[0]]), "shard": left["shard"][0].as_py(),
                                    "payload": packed(ids[own], found.count[own].astype(np.int64))})
        return pa.Table.from_pylist(out, schema=schema)

    return texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(count, "part long, shard long, payload binary")


def _frequent(listed: DataFrame, least: int, by_shard: bool) -> DataFrame:
    """``ids, f`` of the phrases that occur ``least`` times or more over all shards, or a row for each ``shard`` that has one."""
    def add(rows):
        sizes, out = defaultdict(list), [pa.table({n: pa.array([], t) for n, t in (("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("f", pa.int64()))})]
        for shard, payload in zip(rows["shard"].to_pylist(), rows["payload"].to_pylist()):
            words, n = unpacked(payload)
            sizes[words.shape[1]].append((np.full(len(n), shard), words, n))
        for size, own in sizes.items():
            shard, words, n = (np.concatenate(x) for x in zip(*own))
            order = np.lexsort(words.T)
            shard, words, n = shard[order], words[order], n[order]
            first = np.flatnonzero(run_starts(*words.T))
            f, held = np.add.reduceat(n, first), np.diff(np.append(first, len(n)))
            at = np.flatnonzero(np.repeat(f >= least, held)) if by_shard else first[f >= least]
            ids = pa.ListArray.from_arrays(np.arange(0, len(at) * size + 1, size, dtype=np.int32), pa.array(words[at].ravel()))
            out.append(pa.table({"shard": shard[at], "ids": ids, "f": np.repeat(f, held)[at]}))
        table = pa.concat_tables(out)
        return table if by_shard else table.drop_columns("shard")

    return listed.groupBy("part").applyInArrow(add, f"{'shard long, ' * by_shard}ids array<bigint>, f long")


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy()


def _nothing(names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array([], pa.int64()) for n in names})


def score_of(a, n, l, r) -> Column:  # noqa: E741
    """``1000 a n / (l r)`` rounded down; products have up to 38 digits."""
    a, n, l, r = (F.col(x) if isinstance(x, str) else x for x in (a, n, l, r))  # noqa: E741
    big = [x.cast("decimal(19, 0)") for x in (a, n, l, r)]
    return F.call_function("div", F.lit(1000).cast("decimal(4, 0)") * big[0] * big[1], big[2] * big[3])


def collocations(
    docs: DataFrame, least: int = LEAST, depth: int = DEPTH, first: int = FIRST, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` best phrases.

    Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces and at blanks and tabs into words.
    Phrases of two to ``depth`` words that occur ``least`` times or more in a language are
    candidates. A cut into two parts scores ``1000 a n / (l r)``, rounded down, from the
    phrase's count a, all words n and the parts' counts; the least score counts, of equal ones that of
    the shortest first part. A candidate inside a longer one of the same count is left out. Best are the
    highest scores, then counts, then the phrase in byte order.

    Null texts have no words, a null language is ``und``, repeated rows count as often as they
    occur, empty tables give no rows, other columns are ignored. A text of any length is cut into
    shards between pieces; one piece stays in one shard.
    """
    parts = partitions(docs.sparkSession)
    made = written(shards(docs, shard_words))
    texts = made.filter("payload IS NOT NULL").select("shard", "payload")
    every = made.filter("payload IS NULL")
    over = Window.partitionBy("lang", "word")
    # A word's number is the least of its rows' over all shards.
    words = written(
        every.select("shard", "local", "lang", "word", "uid", F.sum("n").over(over).alias("f"), F.min("uid").over(over).alias("gid"))
        .filter(F.col("f") >= least))
    known = words.select("shard", "local", "gid")
    by_pair = Window.partitionBy("first", "second")
    pairs = written(_pairs(texts, known).withColumn("f", F.sum("n").over(by_pair)).filter(F.col("f") >= least).drop("n"))

    names = words.filter("uid = gid").select("gid", "lang", F.col("word").cast("string").alias("word"), "f")
    counts = names.select(F.array("gid").alias("ids"), "f").unionByName(
        pairs.select(F.array("first", "second").alias("ids"), "f").distinct())
    here = words.select("shard", F.col("local").cast("long").alias("local"), F.array("gid").alias("ids"))

    def with_phrases(rows):
        return here.unionByName(rows.select("shard", F.lit(None).cast("long").alias("local"), "ids"))

    if depth > 2:
        three = _longer(texts, with_phrases(pairs.select("shard", F.array("first", "second").alias("ids"))), 2, 3, parts)
        triples = written(_frequent(three, least, by_shard=True))
        counts = counts.unionByName(triples.select("ids", "f").distinct())
    if depth > 3:
        counts = counts.unionByName(_frequent(_longer(texts, with_phrases(triples), 3, depth, parts), least, by_shard=False))
    counts = written(counts)

    # Extensions by one word, on either side, that are as frequent as the phrase itself.
    inside = counts.filter("size(ids) > 2").select(F.explode(F.array(
        F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "f")
    most = inside.groupBy("ids").agg(F.max("f").alias("most"))
    left = counts.filter("size(ids) > 1").join(written(most), "ids", "left").filter("most IS NULL OR most < f").drop("most")
    left = written(left.withColumnRenamed("f", "a"))

    cuts = left.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")).selectExpr(
        "ids", "a", "k", "slice(ids, 1, k) AS one", "slice(ids, k + 1, size(ids) - k) AS two")
    parts = cuts.join(counts.select(F.col("ids").alias("one"), F.col("f").alias("l")), "one").join(
        counts.select(F.col("ids").alias("two"), F.col("f").alias("r")), "two")
    worded = left.select("ids", F.posexplode("ids").alias("at", "gid")).join(names, "gid").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.max("lang").alias("lang"))
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = (
        parts.join(written(worded), "ids").join(written(totals), "lang")
        .withColumn("score", score_of("a", "n", "l", "r"))
        .groupBy("lang", "ids", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), F.col("phrase"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first).select(
        "lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
