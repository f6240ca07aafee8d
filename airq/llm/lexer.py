"""Lower-case words of a batch of texts as 64-bit hashes, without a Python loop per word.

A word is a run of ASCII letters and digits and of characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from airq.llm.rolling import prefix, run_starts, spans

LETTER = np.zeros(256, dtype=bool)
LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
LETTER[128:] = True
CHUNK = 1 << 20


class Lexed(NamedTuple):
    """Some rows of a batch: ``data`` holds their lower-case texts, each ended by a line feed."""

    rows: range
    data: np.ndarray
    start: np.ndarray  # of each row's text, and the end of the last
    word: np.ndarray  # hash of each word
    doc: np.ndarray  # row of each word, counted from the first of ``rows``
    sums: np.ndarray
    low: np.ndarray  # bytes of each word
    high: np.ndarray

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``doc, hash`` of the first ``size`` bytes of the words that are longer."""
        long = np.flatnonzero(self.high - self.low > size)
        return self.doc[long], spans(self.sums, self.low[long], self.low[long] + size)


def lexed(texts: pa.Array, size: int = CHUNK) -> Iterator[Lexed]:
    """Pieces of a text column; null counts as empty. A very long text is a piece of its own."""
    bodies = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    first, held = 0, 0
    for i, body in enumerate(bodies):
        if held and held + len(body) > size:
            yield _piece(bodies, first, i)
            first, held = i, 0
        held += len(body) + 1
    if first < len(bodies):
        yield _piece(bodies, first, len(bodies))


def _piece(bodies: list[bytes], first: int, end: int) -> Lexed:
    own = bodies[first:end]
    data = np.frombuffer(b"\n".join(own) + b"\n", dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum([len(b) + 1 for b in own])])
    inside = LETTER[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    low, high = edge[::2], edge[1::2]
    sums = prefix(data)
    doc = np.searchsorted(start, low, side="right") - 1
    return Lexed(range(first, end), data, start, spans(sums, low, high), doc, sums, low, high)


def distinct_words(piece: Lexed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, word, count`` of the distinct words of every row."""
    order = np.lexsort((piece.word, piece.doc))
    doc, word = piece.doc[order], piece.word[order]
    at = np.flatnonzero(run_starts(doc, word))
    return doc[at], word[at], np.diff(np.append(at, len(doc)))
