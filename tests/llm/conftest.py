"""Small documents with every awkward case, and helpers of the tests of this folder."""

from __future__ import annotations

import random

import pytest

from llm.helpers import DOCS, prose

@pytest.fixture(scope="session")
def rows():
    """Texts with copies, shared passages, nulls, empties, odd bytes and a long one."""
    rng = random.Random(11)
    passage = prose(rng, 40, 5000)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3]] * 9 + [texts[7]] + [texts[8] + " x"] * 2
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(30)]
    texts += [None, "", " \t\n", "a", "É é ü ß", "a" * 300, "a" * 300 + "b", "x\0y" * 40, "💡 " * 70]
    texts += [prose(rng, 6000, 10 ** 6), prose(rng, 5), passage]
    rng.shuffle(texts)
    made = [(i * 3 + 1, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
