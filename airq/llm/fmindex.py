"""FM-index in both directions over a sequence of word numbers, in numpy.

Phrases are intervals of two tables: places of the text in the order of the words that
follow, and places of the reversed text in the order of the words that precede. One step
extends every phrase of a list by every word that stands before (or after) it, and
keeps both intervals in step. Places need to be in order for as many words as a phrase
may have, so they are sorted by that many only.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

from airq.llm.rolling import run_starts


class Phrases(NamedTuple):
    """Phrases of one length: their words and their intervals in both tables."""

    words: np.ndarray  # one row per phrase
    count: np.ndarray
    low: np.ndarray  # first place in the table of the text
    back: np.ndarray  # first place in the table of the reversed text


class Side(NamedTuple):
    """One direction: the word before each place of the table, and the place one word earlier."""

    before: np.ndarray
    step: np.ndarray


def side(text: np.ndarray, depth: int) -> Side:
    """Table of ``text``, whose first element is a break, for phrases of up to ``depth`` words."""
    n = len(text)
    order, rank, width = np.argsort(text, kind="stable"), text.astype(np.int64), 1
    while width < depth:
        # Break or end: what follows does not matter, no phrase goes on there.
        next_rank = np.zeros(n, dtype=np.int64)
        next_rank[: n - width] = rank[width:] + 1
        key = rank * (n + int(text.max(initial=0)) + 2) + next_rank
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(run_starts(key[order])) - 1
        width *= 2
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return Side(text[order - 1], place[order - 1])


class Index:
    """Both tables of a text; 0 is a break that no phrase crosses, words are 1 and up."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.concatenate([[0], text, [0]]).astype(np.int32)
        self.depth = depth

    @functools.cached_property
    def forward(self) -> Side:
        return side(self.text, self.depth)

    @functools.cached_property
    def reverse(self) -> Side:
        return side(self.text[::-1], self.depth)

    def single(self) -> Phrases:
        """The words that occur, as phrases of length one."""
        counts = np.bincount(self.text)
        low = np.cumsum(counts) - counts
        words = np.flatnonzero(counts)
        words = words[words > 0]
        return Phrases(words[:, None], counts[words], low[words], low[words])

    def left(self, phrases: Phrases) -> Phrases:
        """All phrases with one more word in front."""
        of, word, count, low, back = _extended(self.forward, phrases.low, phrases.count, phrases.back)
        return Phrases(np.concatenate([word[:, None], phrases.words[of]], axis=1), count, low, back)

    def right(self, phrases: Phrases) -> Phrases:
        """All phrases with one more word behind."""
        of, word, count, back, low = _extended(self.reverse, phrases.back, phrases.count, phrases.low)
        return Phrases(np.concatenate([phrases.words[of], word[:, None]], axis=1), count, low, back)


def _extended(table: Side, low: np.ndarray, count: np.ndarray, other: np.ndarray):
    """Phrase, new word, count and both new intervals of every extension that occurs."""
    of = np.repeat(np.arange(len(low)), count)
    row = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    word = table.before[row]
    # Rows are in the order of phrases already, so only words inside a phrase are sorted.
    order = np.argsort(of * (int(word.max(initial=0)) + 1) + word, kind="stable")
    of, word, step = of[order], word[order], table.step[row[order]]
    at = np.flatnonzero(run_starts(of, word))
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    size = np.diff(np.append(at, len(of)))
    # In the other table an extension comes after those by smaller words, breaks among them.
    smaller = at - (np.cumsum(count) - count)[of[at]]
    new, real = np.minimum.reduceat(step, at), word[at] > 0
    own = of[at]
    return own[real], word[at][real].astype(np.int64), size[real], new[real], (other[own] + smaller)[real]
