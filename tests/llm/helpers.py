"""Helpers of the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def nasty(spark, docs):
    """``docs`` with names that operators use inside, some rows twice, and nulls everywhere."""
    more = spark.createDataFrame([(None, None, None, None, None), (None, "a b c", None, None, None), (5, None, "en", None, 1)], DOCS)
    out = docs.unionByName(more).unionByName(docs.limit(7))
    for name in ("part", "bucket", "sha", "fp", "u", "row", "key", "kind", "payload", "rank", "copies", "table"):
        out = out.selectExpr("*", f"'clash' AS `{name}`")
    return out
