"""Suffix-array deduplication on windows of bytes, by external induced sorting.

Super-k-mers bring all windows that can be equal to one shard (see ``superkmer``). A
shard sorts the suffixes of those strings that have a window whose hash recurs, by their
first ``width`` bytes:

1. Suffixes are of type L or S (larger or smaller than their right neighbour); the
   leftmost S of each run starts a piece. Pieces are named in order, and the
   string of names is sorted by recursion, or by prefix doubling once it is short.
2. The sorted piece starts are scanned upwards: each suffix that comes out of
   the queue puts its left neighbour, if that is of type L, into the queue of that
   one's first symbol. What goes into a queue in scan order comes out sorted.
3. A scan downwards does the same for type S, and gives all suffixes in order.

Queue tuples are (suffix, common prefix with the tuple before). The common prefix of
two induced suffixes is one more than the least common prefix between their
right neighbours, kept per queue as a running minimum. Queues hold their tuples in
memory up to a bound, then append them to an unlinked scratch file. Scans work on
blocks of a queue at a time.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from airq.llm.rolling import grams, run_starts
from airq.llm.superkmer import CROWDED, Classes, Units, chunk_slices, remove_repeats

#: Bytes of a window, and of the pieces its minimiser is chosen from.
WIDTH, GRAM = 50, 16
#: Tuples that a queue holds in memory, and names that are sorted in memory.
HELD, BASE = 1 << 22, 1 << 22
BLOCK = 1 << 16
TUPLE = np.dtype([("at", "<i8"), ("lcp", "<i2")])


class Queues:
    """One first-in-first-out queue of (suffix, common prefix) tuples per symbol, on disk beyond ``held``."""

    def __init__(self, held: int):
        self.limit, self.n, self.file = held, 0, None
        self.memory: dict[int, list[np.ndarray]] = {}
        self.disk: dict[int, list[tuple[int, int]]] = {}

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(at), dtype=TUPLE)
        rows["at"], rows["lcp"] = at, lcp
        self.memory.setdefault(symbol, []).append(rows)
        self.n += len(rows)
        if self.n > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, blocks in self.memory.items():
            rows = np.concatenate(blocks)
            self.disk.setdefault(symbol, []).append((self.file.tell(), len(rows)))
            self.file.write(rows.tobytes())
        self.memory, self.n = {}, 0

    def _read(self, start: int, count: int) -> np.ndarray:
        self.file.seek(start)
        return np.frombuffer(self.file.read(count * TUPLE.itemsize), dtype=TUPLE)

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks in order of arrival, with those that arrive meanwhile."""
        while symbol in self.disk or symbol in self.memory:
            if symbol in self.disk:  # older than what is in memory
                for start, count in self.disk.pop(symbol):
                    for at in range(0, count, BLOCK):
                        yield self._read(start + at * TUPLE.itemsize, min(BLOCK, count - at))
                continue
            rows = np.concatenate(self.memory.pop(symbol))
            self.n -= len(rows)
            for at in range(0, len(rows), BLOCK):
                yield rows[at:at + BLOCK]

    def pop_reversed(self, symbol: int) -> Iterator[np.ndarray]:
        blocks = self.memory.pop(symbol, [])
        if blocks:
            rows = np.concatenate(blocks)[::-1]
            self.n -= len(rows)
            for at in range(0, len(rows), BLOCK):
                yield rows[at:at + BLOCK]
        for start, count in reversed(self.disk.pop(symbol, [])):
            for end in range(count, 0, -BLOCK):
                begin = max(0, end - BLOCK)
                yield self._read(start + begin * TUPLE.itemsize, end - begin)[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by ``key``; ``rows`` are whole groups. Returns rows still tied.

    A rank is the place of its group's first member, so ranks of other groups stay.
    """
    own = rank[rows]
    bits = int(key.max()).bit_length() if len(key) else 0
    if not own.any():
        order = np.argsort(key)
    elif bits + int(own.max()).bit_length() < 64:
        order = np.argsort(own << bits | key)
    else:
        order = np.lexsort((key, own))
    rows, key = rows[order], key[order]
    old = rank[rows]
    group = run_starts(old)
    part = run_starts(old, key)
    place = np.arange(len(rows))
    group_at = np.maximum.accumulate(np.where(group, place, 0))
    part_at = np.maximum.accumulate(np.where(part, place, 0))
    rank[rows] = old + part_at - group_at
    size = np.diff(np.append(np.flatnonzero(part), len(rows)))
    return rows[np.repeat(size > 1, size)]


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``names`` in order of their first ``depth`` names."""
    rank = np.zeros(len(names), dtype=np.int64)
    rows = refine(rank, np.arange(len(names)), names)
    step = 1
    while step < depth and len(rows):
        ahead = rows + step
        key = np.where(ahead < len(names), rank[np.minimum(ahead, len(names) - 1)] + 1, 0)
        rows = refine(rank, rows, key)
        step *= 2
    return np.argsort(rank)  # what is still tied may come in any order


def _types(text: np.ndarray) -> np.ndarray:
    """Mask of S: the next differing symbol is larger. The last symbol is the least."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    place = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(place[::-1])[::-1]
    rising = np.append(text[1:] > text[:-1], True)
    return rising[at]


def _runs(text: np.ndarray, at: int, limit: int) -> int:
    """Length of the run of one symbol that begins at ``at``."""
    piece = text[at:at + limit]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def _names(text: np.ndarray, small: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Ranks of the pieces, each from its start to the start of the next one."""
    size = np.append(np.diff(pieces) + 1, 1)
    size[text[pieces] == 0] = 1
    bits = int(2 * int(text.max()) + 1).bit_length()
    per = max(1, 63 // bits)
    codes = text.astype(np.int64) * 2 + small
    rank, rows, offset = np.zeros(len(pieces), dtype=np.int64), np.arange(len(pieces)), 0
    while len(rows):
        key = np.zeros(len(rows), dtype=np.int64)
        for j in range(offset, offset + per):
            inside = j < size[rows]
            at = np.minimum(pieces[rows] + j, len(text) - 1)
            key = (key << bits) | np.where(inside, codes[at], 0)
        rows = refine(rank, rows, key)
        offset += per
        longer = size[rows] > offset
        if not longer.any():
            break
        # Whole groups stay together: pieces that ended are equal to one another only.
        rows = rows[np.isin(rank[rows], rank[rows[longer]])]
    return rank


def _seed_lcp(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, at most ``depth``, of each suffix with the one before it in ``order``."""
    step = 8 // text.itemsize
    padded = np.append(text, np.zeros(depth + step, dtype=text.dtype))
    words = np.lib.stride_tricks.as_strided(
        padded.view(np.uint64) if len(padded) % step == 0 else padded[: len(padded) // step * step].view(np.uint64),
        shape=(len(text) + depth,), strides=(text.itemsize,))
    # Symbols up to the zero that ends the string a suffix lies in.
    place = np.where(text == 0, np.arange(len(text)), len(text))
    left = np.minimum(np.minimum.accumulate(place[::-1])[::-1] - np.arange(len(text)), depth)
    lcp = np.zeros(len(order), dtype=np.int64)
    rows = np.arange(1, len(order))
    for j in range(0, depth, step):
        differ = words[order[rows] + j] ^ words[order[rows - 1] + j]
        equal = differ == 0
        ends = differ[~equal]
        lcp[rows[~equal]] = j + np.bitwise_count((ends & (~ends + np.uint64(1))) - np.uint64(1)) // (8 * text.itemsize)
        rows = rows[equal]
        lcp[rows] = depth
        if not len(rows):
            break
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[order[1:]], left[order[:-1]]))
    lcp[:1] = 0
    return lcp.astype(np.int16)


class _Scan:
    """Pushes left neighbours of scanned suffixes with their common prefixes."""

    def __init__(self, text: np.ndarray, depth: int, queues: Queues, n_symbols: int):
        self.text, self.depth, self.queues = text, depth, queues
        self.least = np.full(n_symbols, -1, dtype=np.int16)  # -1: nothing pushed so far

    def block(self, at: np.ndarray, lcp: np.ndarray, take) -> None:
        """``lcp``: with the suffix scanned before. ``take``: mask of the symbols to push."""
        symbol = self.text[at - 1]
        chosen = np.flatnonzero((at > 0) & take(symbol))
        floor = int(lcp.min())
        if not len(chosen):
            np.minimum(self.least, floor, out=self.least)
            return
        order = np.argsort(symbol[chosen], kind="stable")
        chosen = chosen[order]
        symbols = symbol[chosen]
        first = run_starts(symbols)
        before = np.where(first, 0, np.append(0, chosen[:-1]) + 1)
        padded = np.append(lcp, np.int16(self.depth))
        ranges = np.stack([before, chosen + 1], axis=1).ravel()
        low = np.minimum.reduceat(padded, ranges)[::2]
        heads = np.flatnonzero(first)
        low[heads] = np.minimum(low[heads], self.least[symbols[heads]])
        made = np.minimum(low + 1, self.depth).astype(np.int16)
        tails = np.append(heads[1:], len(chosen)) - 1
        own = symbols[heads]
        np.minimum(self.least, floor, out=self.least)
        # What was scanned after a queue's last push counts for its next one.
        behind = np.minimum.accumulate(padded[::-1])[::-1]
        self.least[own] = behind[chosen[tails] + 1]
        for symbol, a, b in zip(own.tolist(), heads.tolist(), (tails + 1).tolist()):
            self.queues.push(symbol, at[chosen[a:b]] - 1, made[a:b])


def induced(text: np.ndarray, depth: int, held: int = HELD, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (suffixes, common prefixes with the one before) in descending order.

    ``text`` holds symbols above zero in strings that each end in a zero. Order and
    common prefixes count the first ``depth`` symbols; suffixes at zeros are left out.
    """
    small = _types(text)
    pieces = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _names(text, small, pieces)
    inner = depth // 2 + 1  # piece starts are at least two symbols apart
    if len(pieces) <= base or len(pieces) < 3:
        seeds = pieces[doubled(names, inner)]
    else:
        _, dense = np.unique(names, return_inverse=True)
        reduced = np.append(dense.astype(np.int64) + 1, 0)
        blocks = [at for at, _ in induced(reduced, inner, held, base)]
        seeds = pieces[np.concatenate(blocks)[::-1]]
    seed_lcp = _seed_lcp(text, seeds, depth)
    symbols = np.unique(text)
    n_symbols = int(symbols[-1]) + 1
    begin = np.searchsorted(text[seeds], symbols)
    end = np.searchsorted(text[seeds], symbols, side="right")

    larger, found = Queues(held), Queues(held)
    scan = _Scan(text, depth, larger, n_symbols)
    last_large: dict[int, int] = {}
    for c, a, b in zip(symbols.tolist(), begin.tolist(), end.tolist()):
        for rows in larger.pop(c):
            at, lcp = rows["at"], rows["lcp"]
            found.push(c, at, lcp)
            last_large[c] = int(at[-1])
            scan.block(at, lcp, lambda s: s >= c)
        if a < b:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = min(_runs(text, last_large[c], depth), _runs(text, int(seeds[a]), depth)) if c in last_large else 0
            for i in range(a, b, BLOCK):
                j = min(b, i + BLOCK)
                scan.block(seeds[i:j], lcp[i - a:j - a], lambda s: s > c)
    smaller = Queues(held)
    scan = _Scan(text, depth, smaller, n_symbols)
    for c in symbols[symbols > 0][::-1].tolist():
        last = None
        for rows in smaller.pop(c):
            at, lcp = rows["at"], rows["lcp"]
            last = int(at[-1])
            yield at, lcp
            scan.block(at, lcp, lambda s: (s <= c) & (s > 0))
        carried = 0
        for rows in found.pop_reversed(c):
            at = rows["at"]
            head = carried
            if last is not None:
                head, last = min(_runs(text, last, depth), _runs(text, int(at[0]), depth)), None
            lcp = np.append(np.int16(head), rows["lcp"][:-1])
            carried = int(rows["lcp"][-1])
            yield at, lcp
            scan.block(at, lcp, lambda s: (s < c) & (s > 0))
    for q in (larger, found, smaller):
        q.close()


def recurring(strings: list[bytes], n_windows: np.ndarray, width: int) -> np.ndarray:
    """Mask of the strings with a window whose hash another window has; windows of the others are equal to none."""
    digest = []
    for at in chunk_slices(strings):
        codes = np.frombuffer(b"".join(strings[at]), dtype=np.uint8)
        n = n_windows[at]
        start = np.cumsum([0, *map(len, strings[at])])[:-1]
        digest.append(grams(codes, width)[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())])
    digest = np.concatenate(digest)
    order = np.argsort(digest)
    ordered = digest[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    twice = np.zeros(len(digest), dtype=bool)
    twice[order[same]] = twice[order[same + 1]] = True
    return np.logical_or.reduceat(twice, np.cumsum(n_windows) - n_windows)


def suffix_classes(width: int, held: int = HELD, base: int = BASE) -> Classes:
    """Equal windows get equal numbers, from the order and common prefixes of all suffixes.

    Strings none of whose windows recurs by its hash are left out of the order; each of their windows is its own class.
    """

    def classes(strings: list[bytes], n_windows: np.ndarray) -> np.ndarray:
        if not strings:
            return np.zeros(0, dtype=np.int64)
        again = recurring(strings, n_windows, width)
        label = np.arange(n_windows.sum())
        chosen = np.flatnonzero(again)
        if len(chosen):
            # Numbers of the order are below that of its windows, the others' follow.
            n_sorted = int(n_windows[chosen].sum())
            of_sorted = np.repeat(again, n_windows)
            label[of_sorted] = by_order([strings[i] for i in chosen.tolist()], n_windows[chosen])
            label[~of_sorted] = np.arange(n_sorted, len(label))
        return label

    def by_order(strings: list[bytes], n_windows: np.ndarray) -> np.ndarray:
        size = np.array([len(s) for s in strings])
        joined = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        text = joined.astype(np.int16) + 1
        start = np.cumsum(size + 1) - size - 1
        text[start + size] = 0
        place = np.full(len(text), -1, dtype=np.int64)  # number of the window that starts there
        at = np.repeat(start, n_windows) + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        place[at] = np.arange(len(at))
        label = np.zeros(len(at), dtype=np.int64)
        number, least = -1, 0  # least common prefix since the last window
        for suffix, lcp in induced(text, width, held, base):
            own = place[suffix]
            which = np.flatnonzero(own >= 0)
            if not len(which):
                least = min(least, int(lcp.min()))
                continue
            between = np.minimum.reduceat(lcp[:which[-1] + 1], np.append(0, which[:-1] + 1))
            between[0] = min(int(between[0]), least)
            names = number + np.cumsum(between < width)
            label[own[which]] = names
            number = int(names[-1])
            rest = lcp[which[-1] + 1:]
            least = int(rest.min()) if len(rest) else width
        return label

    return classes


def _kept(body: bytes, gone: np.ndarray) -> tuple:
    kept = np.frombuffer(body, dtype=np.uint8)[~gone].tobytes() if gone.any() else body
    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return len(body), int(gone.sum()), n_spans, kept, hashlib.sha256(kept).hexdigest()


def suffix_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, parts: int | None = None,
    held: int = HELD, base: int = BASE, crowded: int = CROWDED,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_bytes, kept_sha256`` for every row of ``docs``.

    A byte of the UTF-8 text goes when a string of ``width`` bytes that covers it
    also starts in a document with a smaller doc_id, judged on the input;
    ``n_spans`` counts maximal removed runs, and the remaining bytes are
    concatenated. See ``remove_repeats`` for nulls, repeated rows and sizes. An empty
    table gives no rows; other columns are ignored.
    """
    return remove_repeats(
        docs, Units(False, width, min(gram, width)), suffix_classes(width, held, base), _kept,
        "n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string", parts, crowded)
