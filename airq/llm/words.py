"""Substring deduplication on windows of words, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame

from airq.llm.superkmer import CROWDED, Units, remove_repeats, window_classes

#: Words of a window, and of the pieces its minimiser is chosen from.
WIDTH, GRAM = 13, 3


def _kept(body: bytes, gone: np.ndarray) -> tuple:
    words = body.split()
    kept = b" ".join(itertools.compress(words, (~gone).tolist()) if gone.any() else words)
    return len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()


def substring_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, parts: int | None = None, crowded: int = CROWDED
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` for every row of ``docs``.

    Words end at ASCII white space and are otherwise unchanged. A word goes
    when a window of ``width`` words that covers it also starts in a document with a
    smaller doc_id, judged on the input; what stays is joined by single spaces. See
    ``remove_repeats`` for nulls, repeated rows and sizes. An empty table gives
    no rows; other columns are ignored.
    """
    units = Units(True, width, min(gram, width))
    return remove_repeats(docs, units, window_classes(units), _kept,
                          "n_words long, n_removed long, kept_text string, kept_sha256 string", parts, crowded)
