"""Exact, SimHash, suffix-array and substring deduplication against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from airq.llm import components, exact, peeling, simhash, suffix, superkmer, words
from llm.helpers import nasty, prose


def test_filter_misses_no_key_and_passes_few_others():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300, 5000):
        keys = np.unique(rng.integers(0, 2 ** 62, n).astype(np.uint64) * np.uint64(2))
        held = peeling.build_filter(keys)
        assert held.may_hold(keys).all()
        others = rng.integers(0, 2 ** 62, 20000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        assert held.may_hold(others).mean() < 1e-3


def test_perfect_hash_gives_every_key_its_own_place():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 4000):
        keys = np.unique(rng.integers(0, 2 ** 62, n).astype(np.uint64))
        places = peeling.build_perfect_hash(keys).index(keys)
        assert sorted(places) == list(range(len(keys)))


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    return {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("split", [-1, 60, 10 ** 6])
def test_exact_dedup(docs, rows, split):
    """Also with an empty snapshot and with an empty batch."""
    snapshot = exact.build_snapshot(docs.filter(f"doc_id <= {split}"), 3)
    groups = exact.exact_dedup(docs.filter(f"doc_id > {split}"), snapshot)
    got = exact.with_groups(docs, groups).collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == brute_exact(rows)


def test_exact_dedup_screens_before_it_compares(docs):
    snapshot = exact.build_snapshot(docs.filter("doc_id <= 150"), 3)
    batch = exact._groups(exact._digests(docs.filter("doc_id > 150")), 3)
    passed = {r.sha for r in exact.screened(batch, snapshot).collect()}
    stored, new = {r.sha for r in snapshot.buckets.collect()}, {r.sha for r in batch.collect()}
    assert stored & new <= passed and len(passed) <= len(stored & new) + 2 and len(new) > len(passed)


def test_exact_dedup_on_awkward_rows(spark, docs, empty):
    odd = nasty(spark, docs)
    snapshot = exact.build_snapshot(odd.filter("doc_id <= 100"), 3)
    got = exact.with_groups(odd, exact.exact_dedup(odd, snapshot)).collect()
    assert len(got) == odd.count()
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact.with_groups(empty, exact.exact_dedup(empty, exact.build_snapshot(empty))).count() == 0


def slow_fingerprint(text):
    out, cur = [], bytearray()
    for b in (text or "").encode():
        if b == 0x20 or 9 <= b <= 13:
            if cur:
                out.append(bytes(cur))
            cur = bytearray()
        else:
            cur.append(b + 32 if 65 <= b <= 90 else b)
    if cur:
        out.append(bytes(cur))
    if not out:
        return 0
    shingles = [b" ".join(out[i:i + 4]) for i in range(max(1, len(out) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(rows):
    for text in [r[1] for r in rows[:60]] + [None, "", "A b", "a B c D", "A\x1cB c d e\x0bF"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute_components(fps):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("top, held", [(0, 1 << 20), (5, 1 << 20), (3, 500)])
def test_ball_hashing_finds_all_links(spark, top, held):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        fps.append(rng.choice(fps) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 6))}))
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.u % (1 << 64): r.v % (1 << 64) for r in components.components(simhash.near_links(frame, 4, top, held)).collect()}
    expected = collections.defaultdict(set)
    for f, c in zip(fps, brute_components(fps)):
        expected[c].add(f)
    made = collections.defaultdict(set)
    for f in fps:
        made[got.get(f, f)].add(f)
    assert sorted(map(sorted, made.values())) == sorted(map(sorted, expected.values()))


def test_simhash_groups(spark, docs, rows):
    fps = [slow_fingerprint(r[1]) for r in rows]
    groups = collections.defaultdict(list)
    for r, c in zip(rows, brute_components(fps)):
        groups[c].append(r[0])
    least = {i: min(ids) for ids in groups.values() for i in ids}
    got = simhash.simhash_groups(docs).collect()
    assert {tuple(r) for r in got} == {(r[0], f"{f:016x}", least[r[0]]) for r, f in zip(rows, fps)}
    kept = [r.doc_id for r in simhash.simhash_dedup(docs).collect()]
    assert sorted(kept) == sorted(set(least.values()))


def test_simhash_on_awkward_rows(spark, docs, empty):
    odd = nasty(spark, docs)
    assert simhash.simhash_groups(odd).count() == odd.count()
    assert simhash.simhash_dedup(odd).columns == odd.columns
    assert simhash.simhash_groups(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1200)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(rows, cut, width):
    """Mask of removed units and the units themselves per (id, text)."""
    owner, out = {}, {}
    key = lambda i: superkmer.NO_ID if i is None else i
    for i, text in sorted({(key(r[0]), r[1] or "") for r in rows}):
        units = cut(text.encode())
        for j in range(len(units) - width + 1):
            w = tuple(units[j:j + width])
            owner[w] = min(owner.get(w, i), i)
        out[i, text] = units
    masks = {}
    for (i, text), units in out.items():
        gone = [False] * len(units)
        for j in range(len(units) - width + 1):
            if owner[tuple(units[j:j + width])] < i:
                gone[j:j + width] = [True] * width
        masks[i, text] = (units, gone)
    return masks


@pytest.mark.parametrize("crowded, parts", [(10 ** 9, 7), (2, 3)])
def test_substring_dedup(docs, rows, crowded, parts):
    expected = {(i, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest())
                for (i, _), (u, g) in brute_removed(rows, bytes.split, 13).items()}
    got = words.substring_dedup(docs, parts=parts, crowded=crowded).drop("kept_text").collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == expected and sum(e[2] for e in expected) > 1000


@pytest.mark.parametrize("crowded, parts, held, base", [(10 ** 9, 7, 1 << 20, 1 << 20), (2, 3, 200, 20)])
def test_suffix_dedup(docs, rows, crowded, parts, held, base):
    """With small bounds the queues go to disk and the sort recurses."""
    expected = set()
    for (i, _), (u, g) in brute_removed(rows, list, 50).items():
        spans = sum(1 for k, x in enumerate(g) if x and (k == 0 or not g[k - 1]))
        kept = bytes(b for b, x in zip(u, g) if not x)
        expected.add((i, len(u), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix.suffix_dedup(docs, parts=parts, crowded=crowded, held=held, base=base).drop("kept_bytes").collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == expected and sum(e[2] for e in expected) > 5000


@pytest.mark.parametrize("operator", [words.substring_dedup, suffix.suffix_dedup])
def test_repeats_on_awkward_rows(spark, docs, empty, operator):
    odd = nasty(spark, docs)
    got = operator(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 2
    assert operator(empty).count() == 0


def test_induced_order_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(150):
        width, letters = rng.choice([1, 2, 3, 5, 8]), rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(width, 30))) for _ in range(rng.randint(1, 12))]
        n = np.array([rng.randint(1, len(s) - width + 1) for s in strings])
        held, base = rng.choice([3, 50, 10000]), rng.choice([1, 3, 10000])
        got = suffix.suffix_classes(width, held, base)(strings, n).tolist()
        want = [s[j:j + width] for s, k in zip(strings, n) for j in range(k)]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_only_strings_with_windows_that_recur_are_put_in_order(monkeypatch):
    rng = random.Random(6)
    strings = list(dict.fromkeys(bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(8, 14))) for _ in range(300)))
    strings += [s[2:] + b"xy" for s in strings[:40]]
    n = np.array([len(s) - 7 for s in strings])
    held, induced = [], suffix.induced
    monkeypatch.setattr(suffix, "induced", lambda text, *more: held.append(len(text)) or induced(text, *more))
    got = suffix.suffix_classes(8)(strings, n).tolist()
    want = [s[j:j + 8] for s, k in zip(strings, n) for j in range(k)]
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))
    count = collections.Counter(want)
    again = [s for s, k in zip(strings, n) if any(count[s[j:j + 8]] > 1 for j in range(k))]
    assert held == [sum(len(s) + 1 for s in again)] and len(again) < len(strings) / 2
    monkeypatch.setattr(suffix, "grams", lambda codes, k: np.zeros(len(codes) - k + 1, dtype=np.uint64))
    assert len(set(zip(suffix.suffix_classes(8)(strings, n).tolist(), want))) == len(set(want))  # hashes decide nothing


def test_window_classes_tell_windows_with_one_hash_apart(monkeypatch):
    monkeypatch.setattr(superkmer, "spans", lambda sums, a, b: np.zeros(len(a), dtype=np.uint64))
    strings = [b"a b c d", b"b c d e", b"x y", b"a b z"]
    got = superkmer.window_classes(superkmer.Units(True, 2, 1))(strings, np.array([3, 3, 1, 2])).tolist()
    want = [b"a b", b"b c", b"c d", b"b c", b"c d", b"d e", b"x y", b"a b", b"b z"]
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_payloads_of_a_large_corpus_are_few():
    """Each part sends a payload to each bucket: 12,000 parts of 48 GB would send 150 million, three times."""
    assert superkmer.parts_of(1) == 1 and superkmer.parts_of(180 << 20) == 45
    assert superkmer.parts_of(700 << 20) == 64 and superkmer.parts_of(10 << 30) == 854
    for gb in (1, 10, 48):
        assert superkmer.parts_of(gb << 30) ** 2 <= gb * gb * 8000


@pytest.mark.parametrize("crowded", [False, True])
def test_equal_windows_of_several_parts_meet_in_one_slice_of_one_bucket(crowded):
    rng = random.Random(4)
    shared = [bytes(rng.choice(b"abcd") for _ in range(60)) for _ in range(8)]
    units, rows, windows = superkmer.Units(False, 12, 5), [], collections.defaultdict(set)
    for part in range(3):
        bodies = [b"".join(rng.choice([*shared, b"%d" % rng.getrandbits(40)]) for _ in range(9)) for _ in range(4)]
        chunk = next(superkmer.chunks_of(bodies, False))
        marks = np.unique(superkmer.super_kmers(chunk, units)[2])
        ids = np.arange(4) + 10 * part
        s = superkmer._strings(ids, bodies, units, marks, np.full(len(marks), crowded), 3)
        for body, n, to, own in zip(s.bodies, s.windows.tolist(), s.buckets.tolist(), s.slices.tolist()):
            for j in range(n):
                windows[body[j:j + 12]].add((to, own))
        assert {(b[j:j + 12], int(i)) for i, b in zip(ids, bodies) for j in range(len(b) - 11)} == {
            (s.bodies[sid][j:j + 12], int(ids[doc])) for sid, doc, _ in s.occurrence.tolist() for j in range(s.windows[sid])}
        ends = np.cumsum([len(b) for b in s.bodies])
        rows.append((part, [np.arange(len(s.bodies)), s.windows, s.slices, s.least, s.most, b"".join(s.bodies), ends]))
    assert all(len(where) == 1 for where in windows.values())
    strings = dict(zip((b for _, r in rows for b in [r[5][a:e] for a, e in zip([0, *r[6]], r[6])]), (int(n) for _, r in rows for n in r[1])))
    slices = {b: int(w) for _, r in rows for b, w in zip([r[5][a:e] for a, e in zip([0, *r[6]], r[6])], r[2])}
    n = np.array(list(strings.values()))
    want = [b[j:j + 12] for b, k in strings.items() for j in range(k)]
    for classes in (suffix.suffix_classes(12), superkmer.window_classes(units)):
        got = superkmer._labels(list(strings), n, np.array(list(slices.values()), dtype=np.uint16), classes, size=200).tolist()
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_a_hot_passage_sends_one_string_per_part(spark):
    rng = random.Random(2)
    passage = prose(rng, 30, 10 ** 6)
    rows = [(i, f"{passage} tail{i}", "en", "s", 1) for i in range(400)]
    got = words.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), parts=4)
    assert sorted((r.n_words, r.n_removed) for r in got.collect()) == [(31, 0)] + [(31, 30)] * 399


def test_the_largest_id_comes_back_as_itself(spark):
    from airq.llm import suffix, words

    top, text = 2 ** 63 - 1, " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(top, text), (None, text), (4, text), (top, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    for removed in (suffix.suffix_dedup(rows), words.substring_dedup(rows)):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in removed.collect()))
        assert got == [(False, 4, False), (False, top, False), (False, top, True), (True, 0, False), (True, 0, False), (True, 0, True)]
