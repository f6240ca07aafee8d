"""Token ids in binary shards with a minimal perfect hash index for keyed access.

A shard is one file with this layout, all numbers little-endian:

    ids        m unsigned integers of 2 or 4 bytes
    doc_ids    n signed 64-bit, ascending; those of documents without one, the last, stand for nothing
    offsets    n + 1 unsigned 64-bit, in ids
    index      perfect hash over the distinct doc_ids, with a 32-bit fingerprint
               and the first position of every key
    magic "TOKS2\\0", bytes per id (u16), documents n (u64), ids m (u64), index bytes (u64),
    documents without a doc_id (u64)

What depends on all ids comes behind them, so a shard is written in one go.

A key is found in constant time: the hash gives its place, the fingerprint and the
stored id tell whether it is there, the offsets where its ids lie. Shards hold
ascending ranges of doc_id; the manifest has one row per shard.

Shards are written by tasks to a folder that all executors share, each under a name
of its own attempt. The manifest names those of the attempts that succeeded, so a
task that runs again leaves an unused file at worst.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airq.llm.peeling import PerfectHash, Shape, build_perfect_hash
from airq.llm.rolling import mix, run_starts
from airq.llm.shared import NO_ID, need, packed, partitions, shared_folder, text_or_empty, unpacked, written

MAGIC, FOOT = b"TOKS2\0", "<6sHQQQQ"
#: Words whose ids a worker remembers, about 50 bytes each; those not used of late make room.
REMEMBERED = 600_000
#: Bytes of texts that are split and looked up at a time.
CHUNK = 4 << 20
#: Punctuation that is looked up apart from the word before it.
MARKS = b".,;:!?#$%&*|"
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"


def _gathered(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` of the given starts and sizes, one after another."""
    first = np.cumsum(size) - size
    return ids[np.repeat(start - first, size) + np.arange(int(size.sum()))]


class Known:
    """Pieces of text with their ids, and a mark of each."""

    def __init__(self, dtype: np.dtype):
        self.keys = pa.array([], pa.string())
        self.mark, self.size = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        self.start, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=dtype)

    def places(self, wanted: pa.Array, learn) -> np.ndarray:
        """Where each of ``wanted``, all different, is; ``learn`` gives marks, sizes and ids of new ones.

        When there are too many, those that are not wanted make room.
        """
        at = pc.index_in(wanted, self.keys)
        new = wanted.filter(at.is_null())
        if len(self.keys) + len(new) > REMEMBERED and at.null_count + len(self.keys) > len(wanted):
            self._keep(at.drop_null().to_numpy())
            at = pc.index_in(wanted, self.keys)
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            out[out < 0] = np.arange(len(self.keys), len(self.keys) + len(new))
            mark, size, ids = learn(new.to_pylist())
            self.keys = pa.concat_arrays([self.keys, new])
            self.mark, self.size = np.append(self.mark, mark), np.append(self.size, size)
            self.start, self.ids = np.append(self.start, len(self.ids) + np.cumsum(size) - size), np.append(self.ids, ids)
        return out

    def _keep(self, at: np.ndarray) -> None:
        self.keys = self.keys.take(pa.array(at))
        self.ids = _gathered(self.ids, self.start[at], self.size[at])
        self.mark, self.size = self.mark[at], self.size[at]
        self.start = np.cumsum(self.size) - self.size


class Encoder:
    """Ids of texts as packed integers.

    The vocabulary must drop white space before anything else (as those with a
    word-splitting pre-tokenizer do), so that a text's ids are those of its words,
    parted at ASCII white space, one after another. ``splits`` checks that on the file.
    """

    def __init__(self, path: str, end_id: int | None, whole: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.end = np.array([] if end_id is None else [end_id], dtype=self.dtype)
        # The same ids without offsets, where the library has it.
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.cores, self.others = Known(self.dtype), Known(self.dtype)
        self.letters: dict[str, bool] = {}
        self.tried: set[str] = set()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(top + 1, dtype=bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_words = not whole and self.splits()
        low = "abcdefghijklmnopqrstuvwxyz"
        self.cuts = all(map(self._apart, low + low.upper()))
        self.folds = self._ids(low.upper()) == self._ids(low) and all(self._ids(c.upper()) == self._ids(c) for c in low)

    def splits(self) -> bool:
        probe = ["a", "b'", "s", "1", "2.", "É"]
        one = self.tokenizer.encode(" \t\n\r\v\f".join(probe), add_special_tokens=False).ids
        return one == [i for w in probe for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _apart(self, char: str) -> bool:
        """Whether ids of a letter and of any mark behind it are those of the two alone.

        Tried on the file, once per character: a letter may be normalised to one with an
        accent of its own, which then belongs to the mark.
        """
        if char not in self.letters:
            marks = MARKS.decode()
            self.letters[char] = char.isalpha() and all(
                self._ids(char + m) == self._ids(char) + self._ids(m) for m in [*marks, marks, marks[::-1]])
            if self.letters[char]:
                self.tried.add(char)
        return self.letters[char]

    def _plain(self, word: str) -> bool:
        """Whether a word consists of such letters."""
        if word.isascii():
            return word.isalpha() and self.cuts
        return word.isalpha() and (self.tried.issuperset(word) or all(map(self._apart, set(word))))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts, and the ids."""
        found = [np.array(e.ids, dtype=self.dtype) for e in self._batch(texts, add_special_tokens=False)]
        return np.array([len(ids) for ids in found], dtype=np.int64), np.concatenate([*found, self.end[:0]])

    def _encoded_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters: some hundred in one text, cut where ids end a word."""
        groups = [words[i:i + 200] for i in range(0, len(words), 200)]
        sizes, found = [np.zeros(0, dtype=np.int64)], [self.end[:0]]
        for group, e in zip(groups, self._batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            size = np.diff(ends, prepend=0)
            if len(ends) != len(group) or ends[-1] != len(ids):
                size, ids = self._encoded(group)
            sizes.append(size)
            found.append(ids)
        return np.concatenate(sizes), np.concatenate(found)

    def _learn_cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks of words of letters, and the ids of these."""
        plain = np.array([self._plain(w) for w in words], dtype=bool)
        size = np.zeros(len(words), dtype=np.int64)
        size[plain], ids = self._encoded_letters([w for w, letters in zip(words, plain.tolist()) if letters])
        return plain, size, ids

    def _learn_others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.ones(len(words), dtype=bool), *self._encoded(words)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of different words, and the ids.

        Letters and the punctuation behind them are looked up apart, ASCII in lower case.
        """
        low = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words) if self.folds else words
        core = pc.ascii_rtrim(low, characters=MARKS.decode())
        coded = core.dictionary_encode()
        at = self.cores.places(coded.dictionary, self._learn_cores)[coded.indices.to_numpy()]
        plain = self.cores.mark[at]
        behind = pc.subtract(pc.binary_length(low), pc.binary_length(core)).to_numpy()
        marked, odd = plain & (behind > 0), ~plain
        rests = [w[-n:] for w, n in zip(low.filter(pa.array(marked)).to_pylist(), behind[marked].tolist())]
        rest = pa.concat_arrays([pa.array(rests, pa.string()), words.filter(pa.array(odd))]).dictionary_encode()
        other = self.others.places(rest.dictionary, self._learn_others)[rest.indices.to_numpy()]
        start, size = np.zeros((len(words), 2), dtype=np.int64), np.zeros((len(words), 2), dtype=np.int64)
        start[:, 0], size[:, 0] = self.cores.start[at], self.cores.size[at]
        for rows, places in ((marked, other[:len(rests)]), (odd, other[len(rests):])):
            start[rows, 1], size[rows, 1] = len(self.cores.ids) + self.others.start[places], self.others.size[places]
        return size.sum(axis=1), _gathered(np.concatenate([self.cores.ids, self.others.ids]), start.ravel(), size.ravel())

    def column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of ids of some texts at a time, and the ids, ends included; no text is null."""
        if not self.by_words:
            for at in range(0, len(texts), 256):
                size, ids = self._encoded(texts.slice(at, 256).to_pylist())
                yield size + len(self.end), np.insert(ids, np.repeat(np.cumsum(size), len(self.end)), np.tile(self.end, len(size)))
            return
        held, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while at < len(texts):
            till = int(np.searchsorted(held, (held[at - 1] if at else 0) + CHUNK, side="right"))
            piece = texts.slice(at, max(1, till - at)).cast(pa.string())
            at += len(piece)
            split = pc.ascii_split_whitespace(piece)
            coded = split.flatten().dictionary_encode()
            size, ids = self._words(coded.dictionary)
            start, code = np.cumsum(size) - size, coded.indices.to_numpy()
            ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
            # A text's end is one more word.
            start = np.insert(start[code], ends, len(ids))
            size = np.insert(size[code], ends, len(self.end))
            total = np.append(0, np.cumsum(size))[np.append(0, ends + np.arange(1, len(ends) + 1))]
            yield np.diff(total), _gathered(np.append(ids, self.end), start, size)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for size, ids in self.column(pa.array(texts, pa.string())):
            ends = np.cumsum(size).tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _index(doc_ids: np.ndarray) -> bytes:
    """Perfect hash of the distinct ids with fingerprint and first position by place."""
    first = np.flatnonzero(run_starts(doc_ids))
    keys = mix(doc_ids[first].view(np.uint64))
    table = build_perfect_hash(keys)
    place = table.index(keys)
    prints, firsts = np.zeros(len(keys), dtype="<u4"), np.zeros(len(keys), dtype="<u8")
    prints[place] = (keys >> np.uint64(32)).astype(np.uint32)
    firsts[place] = first
    return packed(*table, prints, firsts)


class Shard(NamedTuple):
    """A shard that was read back; ``ids`` is a view of the file's bytes."""

    ids: np.ndarray
    doc_ids: np.ndarray
    offsets: np.ndarray
    table: PerfectHash
    prints: np.ndarray
    firsts: np.ndarray
    nameless: int  # documents at the end that have no id

    def find(self, doc_ids: np.ndarray) -> np.ndarray:
        """First position of each id, -1 for those the shard does not have."""
        keys = mix(doc_ids.astype(np.int64).view(np.uint64))
        place = self.table.index(keys)
        at = self.firsts[place].astype(np.int64)
        there = (self.prints[place] == (keys >> np.uint64(32)).astype(np.uint32)) & (self.doc_ids[at] == doc_ids)
        return np.where(there, at, -1)

    def get(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with ``doc_id``."""
        at = int(self.find(np.array([doc_id]))[0])
        return None if at < 0 else self.ids[self.offsets[at]:self.offsets[at + 1]]


def read_shard(path: str) -> Shard:
    fs, name = _filesystem(path)
    with fs.open_input_stream(name, compression=None) as file:
        data = file.read()
    if len(data) < struct.calcsize(FOOT) or not data[-struct.calcsize(FOOT):].startswith(MAGIC):
        raise ValueError(f"{path} is not a token shard")
    _, width, n, m, size, nameless = struct.unpack_from(FOOT, data, len(data) - struct.calcsize(FOOT))
    ids = np.frombuffer(data, f"<u{width}", m)
    at = m * width
    doc_ids = np.frombuffer(data, "<i8", n, at)
    offsets = np.frombuffer(data, "<u8", n + 1, at + 8 * n).astype(np.int64)
    at += 8 * (2 * n + 1)
    shape, choice, ranks, prints, firsts = unpacked(data[at:at + size])
    return Shard(ids, doc_ids, offsets, PerfectHash(Shape(*shape), choice, ranks), prints, firsts, nameless)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Write the ids of every text of ``docs`` and return the manifest, in order of doc_id.

    A null text is empty and still gets the end id; a null doc_id sorts last. Rows repeated with one id lie side by side in order of
    their text's hash. An empty table gives an empty manifest. A range of ids is
    streamed through one task; only its ids' offsets and index stay in memory.
    """
    need(docs, "doc_id", "text")
    folder = shared_folder(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards or 2 * partitions(docs.sparkSession), F.col("doc_id").asc_nulls_last(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        fs, root = _filesystem(folder)
        doc_ids, sizes, file, path, nameless = [], [], None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                fs.create_dir(root, recursive=True)
                path = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                file = fs.open_output_stream(f"{root}/{path}.bin", compression=None)
            for size, ids in encoder.column(batch.column("text")):
                file.write(ids.tobytes())
                sizes.append(size)
            nameless += batch.column("doc_id").null_count
            doc_ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
        if file is None:
            return
        doc_ids, sizes = np.concatenate(doc_ids), np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        index = _index(doc_ids)
        with file:
            file.write(doc_ids.astype("<i8").tobytes())
            file.write(offsets.tobytes())
            file.write(index)
            file.write(struct.pack(FOOT, MAGIC, encoder.dtype.itemsize, len(doc_ids), int(offsets[-1]), len(index), nameless))
        yield pa.record_batch({
            "shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{path}.bin"],
            "n_docs": [len(doc_ids)], "n_ids": [int(offsets[-1])], "first_id": [int(doc_ids[0])], "last_id": [int(doc_ids[-1])]})

    return written(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids
    as 32-bit integers. Every document is looked up by its key. Shards are read one
    per row of the manifest, which has one row per written partition.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))).select("path", "base")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = read_shard(path)
                first = shard.find(shard.doc_ids)
                if (first < 0).any():
                    raise ValueError(f"{path}: a key is missing from its index")
                again = np.arange(len(first)) - np.maximum.accumulate(np.where(run_starts(shard.doc_ids), np.arange(len(first)), 0))
                at = first + again
                start, stop = shard.offsets[at], shard.offsets[at + 1]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(start.tolist(), stop.tolist())]
                ids = shard.doc_ids
                yield pa.record_batch({
                    "doc_id": pa.array(ids, mask=np.arange(len(ids)) >= len(ids) - shard.nameless), "start": pa.array(start + base),
                    "n_tokens": pa.array(stop - start), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.repartition(2 * partitions(spark), "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")
