"""Near copies by MinHash against brute force over full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from airq.llm import minhash, queries
from llm.helpers import DOCS, nasty, prose


def brute_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Component of every (doc_id, text), by comparing all pairs of distinct sets."""
    sets = [brute_set(t) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            n = len(a & b)
            if 100 * n >= 85 * (len(a) + len(b) - n):
                parent[find(a)] = find(b)
    least = {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    return [(d, len(s), least.get(find(s)) if s else d) for (d, _), s in zip(rows, sets)]


def changed(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"z{rng.random()}"
    return " ".join(words)


def made(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = prose(rng, rng.choice([9, 12, 40, 150, 400]), 5000).split()
        texts += [changed(rng, words, rng.randint(0, max(1, len(words) // 40))) for _ in range(rng.randint(1, 6))]
    base = prose(rng, 300, 5000).split()
    texts += [" ".join(base)] + [changed(rng, base, 4) for _ in range(60)] + [changed(rng, base, 9) for _ in range(60)]
    passage = prose(rng, 30, 5000)
    texts += [f"{prose(rng, rng.randint(1, 40), 5000)} {passage}" for _ in range(80)]
    rng.shuffle(texts)
    return [(i * 2 + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def check(spark, rows, **bounds):
    docs = nasty(spark, rows) if not isinstance(rows, list) else spark.createDataFrame(rows, DOCS).repartition(4)
    docs = docs.cache()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = minhash.minhash_groups(docs, **bounds)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got.drop("kept").collect()), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    return want


@pytest.mark.parametrize("bounds", [{}, {"most": 20, "shingles": 3000}])
def test_components_equal_brute_force(spark, bounds):
    want = check(spark, made(5), **bounds)
    assert len({c for *_, c in want}) < len(want) - 60


def test_awkward_rows(spark, docs):
    check(spark, docs)


def test_rows_without_ids_and_empty_tables(spark, empty):
    rng = random.Random(8)
    words = prose(rng, 200, 5000).split()
    rows = [(None, changed(rng, words, 2), None, None, None) for _ in range(4)] + [(None, None, None, None, None)] * 2
    check(spark, rows)
    check(spark, [*rows, (9, " ".join(words), None, None, None), (4, "", "x", None, None)])
    assert minhash.minhash_groups(empty).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, "/root/testdata/sf0.001").collect()]
    got = queries.op12_minhash(spark, "/root/testdata/sf0.001").drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_every_coordinate_fills_and_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.85, 0.95):
        for n in (7, 40, 400, 3000):
            agree = []
            for _ in range(12):
                own = rng.integers(0, 2 ** 63, size=2 * n, dtype=np.uint64)
                common = int(round(2 * n * share / (1 + share)))
                a, b = own[:n], np.concatenate([own[:common], own[n: 2 * n - common]])
                s = minhash.sketches([a, b], 192)
                assert not (s == minhash._FULL).any()
                agree.append((s[0] == s[1]).mean())
            true = common / (2 * n - common)
            assert abs(np.mean(agree) - true) < 4.5 * (true * (1 - true) / 192 / 12) ** 0.5 + 0.01


def test_recall_by_similarity_of_the_bands():
    rng = np.random.default_rng(6)
    for share in (0.85, 0.9, 0.95):
        met = 0
        for _ in range(300):
            own = rng.integers(0, 2 ** 63, size=400, dtype=np.uint64)
            common = int(np.ceil(400 * share / (1 + share)))
            sets = [own[:200], np.concatenate([own[:common], own[200: 400 - common]])]
            keys = minhash.band_keys(minhash.sketches(sets, 192), 32, 6)
            met += bool((keys[0] == keys[1]).any())
        assert met == 300


def test_links_of_a_block_connect_what_is_similar():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, size=300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > p], rng.integers(0, 2 ** 63, size=int(300 * p), dtype=np.uint64)]))
            for p in (0, *[0.03] * 20, *[0.12] * 20)]
    links = minhash.links_within(sets, np.arange(len(sets)), np.arange(len(sets)))
    similar = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
               if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))]
    assert len(links) < len(sets) and len(similar) > 100

    def labels(pairs):
        out = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                out[i] = out[j] = min(out[i], out[j])
        return out

    assert labels(links) == labels(similar)
