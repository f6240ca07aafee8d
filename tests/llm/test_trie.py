"""The prefix trie against a plain one, on awkward tables too."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from airq.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes of the trie, in plain Python; turn numbers of a conversation must differ."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        built[c] = tuple(turns.get(c - base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, out = defaultdict(list), {}
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if kids[node] else 1
        for k in kids[node]:
            saved += out[k][6]
            leaves += out[k][5]
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        out[node] = [members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]),
                     len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()]
    return sorted((tuple(v) for v in out.values()), key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("depth", "ka", "block", "at", "task", "place", "weight"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    got = trie.prefix_trie(df)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def made(seed, n=300, words=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(-150, 450), rng.randint(0, 99)])
        if any(r[0] == c for r in rows):
            continue
        for turn in rng.sample([None, *range(9)], rng.randint(1, 8)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé💡", None, "", "x" * 3000][:words + 2])))
    return rows


@pytest.mark.parametrize("seed, words", [(1, 3), (2, 0), (3, -1)])
def test_nodes_equal_those_of_a_plain_trie(spark, seed, words):
    rows = made(seed, words=words)
    assert trie_rows(spark, rows) == brute(rows)


def test_a_long_conversation_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(7, t, "user", f"t{t % 5}") for t in range(300)]
    rows += [(107, t, "user", f"t{t % 5}") for t in range(150)]
    rows += [(1000 + c, t, "user", f"hot{t}") for c in range(0, 400) for t in range(7)]
    assert trie_rows(spark, rows) == brute(rows)


def test_defined_results_of_awkward_tables(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []
    # No turn is left of a short conversation whose hundred has no first one: it ends at the root.
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    (root,) = trie_rows(spark, [(short, 0, "user", "x"), (None, None, None, None)])
    assert root == (short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())
    # Repeated rows are turns of their own, whatever order they come in.
    rows = [(100, 1, "user", "x")] * 3 + [(100, 1, "user", "y")] * 2
    assert len(trie_rows(spark, rows)) == 6 and trie_rows(spark, rows) == trie_rows(spark, rows[::-1])


def test_query_has_every_conversation_below_its_root(spark):
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.001").filter("depth = 0").collect()
    n = queries.documents(spark, "/root/testdata/sf0.001", "conversations").select("conv_id").distinct().count()
    assert [r.n_convs for r in got] == [n]
