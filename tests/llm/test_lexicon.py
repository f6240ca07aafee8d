"""What counts as a copy when the lexicon is taken."""

from __future__ import annotations

import numpy as np

from airq.llm import quality


def test_documents_that_share_their_least_mark_are_not_copies():
    """Mark 1 is frequent and the least of all; 900 is in five different toxic documents, 800 in copies of one."""
    docs = [[1, 900, 10 + i] for i in range(5)] + [[1, 800, 50]] * 9 + [[1, 100 + i] for i in range(200)]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    word = np.concatenate(docs).astype(np.uint64)
    toxic = np.array([1.0] * 14 + [0.0] * 200)
    assert quality.find_lexicon(doc, word, toxic).tolist() == [900]
    again = np.random.default_rng(1).permutation(len(doc))
    assert quality.find_lexicon(doc[again], word[again], toxic).tolist() == [900]
