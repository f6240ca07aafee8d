"""Decontamination, mixing, the quality classifier and the pipeline."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airq.llm import decontam, lexer, mixing, quality, queries
from llm.helpers import nasty, prose

SF = "/root/testdata/sf0.01"


def test_masks_fit_whatever_three_of_sixteen_tokens_are_replaced():
    for bad in itertools.combinations(range(16), 3):
        assert any(not {o + p for p in m} & set(bad) for m in decontam.MASKS for o in range(16 - m[-1]))


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_leaks(docs, items):
    found = {}
    for doc_id, text in docs:
        w = words_of(text or "")
        hits = set()
        for item_id, item in items:
            v = words_of(item or "")
            width = min(decontam.STRETCH, len(v))
            if len(v) < decontam.LEAST:
                continue
            for a in range(len(w) - width + 1):
                if any(sum(x == y for x, y in zip(w[a:a + width], v[b:b + width])) >= decontam.AGREE * width
                       for b in range(len(v) - width + 1)):
                    hits.add(item_id)
                    break
        found[doc_id] = sorted(hits)
    return found


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination(spark, block_bytes):
    """Whole, cut and altered passages are found, clean documents are left alone."""
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randint(16, 40), 4000)) for i in range(12)] + [(90, None), (91, "too few words"), (92, prose(rng, 9, 4000))]
    docs = []
    for i in range(60):
        item = rng.choice(items)[1]
        parts = [prose(rng, rng.randint(0, 80), 4000)]
        if i % 3 and item:
            leak = item.split()
            for _ in range(i % 4):
                leak[rng.randrange(len(leak))] = f"new{rng.randrange(99)}"
            cut = rng.choice([0, 0, 3])
            parts.append(" ".join(leak[cut:]).upper().replace(" ", rng.choice([" ", ", ", "\n"])))
        docs.append((i, " ".join([*parts, prose(rng, rng.randint(0, 30), 4000)])))
    docs += [(100, None), (101, ""), (102, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    want = brute_leaks(docs, items)
    assert {r.doc_id: r.item_ids for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (not want[r.doc_id]) for r in got) and sum(map(bool, want.values())) > 25


def test_decontamination_on_awkward_rows(spark, docs, empty):
    bench = spark.createDataFrame([(1, prose(random.Random(1), 20)), (None, None), (2, "")], "item_id long, text string")
    odd = nasty(spark, docs)
    assert decontam.contaminated(odd, bench).count() == odd.count()
    assert decontam.contaminated(odd, bench.limit(0)).filter("kept").count() == odd.count()
    assert decontam.decontaminated(odd, bench).columns == odd.columns
    assert decontam.contaminated(empty, bench).count() == 0


def test_lexer_cuts_words_like_a_pattern():
    texts = ["A b,c", None, "", "É-é 1x_y", "\n\n", "  end"]
    for size in (1, 1 << 20):
        out = [[] for _ in texts]
        for piece in lexer.lexed(pa.array(texts), size):
            for d, w in zip(piece.doc, piece.word):
                out[piece.rows.start + d].append(int(w))
        assert [len(o) for o in out] == [3, 0, 0, 4, 0, 1]
    assert out[3][0] == out[3][1]


def test_mixture_meets_its_targets(spark):
    r = queries.op9_mixing(spark, SF).collect()
    shares, tokens, rate = (np.array([x[c] for x in r]) for c in ("shares", "n_tokens", "rate"))
    total = (rate * tokens) @ shares
    names = sorted(queries.DOMAIN_WEIGHTS)
    assert np.allclose(total / total.sum(), [queries.DOMAIN_WEIGHTS[n] for n in names], atol=1e-4)
    assert rate.min() > 0.99 and min(x.copies for x in r) >= 1 and np.allclose(shares.sum(axis=1), 1)
    copies = np.array([x.copies for x in r])
    assert np.all(np.abs(copies - rate) <= 1) and abs(copies.sum() - rate.sum()) < 4 * np.sqrt(len(r))


def test_domains_are_predicted_for_documents_without_a_label(spark):
    docs, labels = queries.documents(spark, SF), queries.documents(spark, SF, "labels")
    names = sorted(queries.DOMAIN_WEIGHTS)
    got = mixing.mixture(docs, labels.filter("doc_id % 2 = 0"), queries.DOMAIN_WEIGHTS).join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r.doc_id % 2 and r.n_tokens >= 10]
    assert np.mean([names[int(np.argmax(r.shares))] == r.lang for r in held]) > 0.97


def test_rates_stay_nonnegative_and_match_a_plain_solver(spark):
    rng = np.random.default_rng(6)
    shares = rng.dirichlet([0.3] * 3, 300)
    tokens = rng.integers(1, 500, 300)
    members = spark.createDataFrame(
        [(i, int(t), s.tolist()) for i, (t, s) in enumerate(zip(tokens, shares))], "row long, n_tokens long, shares array<double>")
    weights = {"a": 0.9, "b": 0.08, "c": 0.02}
    total = float(tokens.sum())
    fit = mixing.fit_rates(members, ["a", "b", "c"], weights, total)
    rate = mixing.rates_of(shares, fit.steps)
    assert rate.min() == 0
    plain = np.ones(300)  # plain projected gradient, many small steps
    target = np.array([0.9, 0.08, 0.02]) * total
    for _ in range(20000):
        plain = np.maximum(0, plain + 0.5 * shares @ (target - (plain * tokens) @ shares) / total)
    assert np.allclose((rate * tokens) @ shares, (plain * tokens) @ shares, rtol=2e-3, atol=1e-3 * total)


def two_domains(spark, per=40):
    """Documents of two languages that share no word, and of a third one, all labelled."""
    rng = np.random.default_rng(3)
    rows = [(i * 3 + k, " ".join(f"{lang}{w}" for w in rng.integers(0, 50, 30)), lang)
            for k, lang in enumerate(("en", "fr", "xx")) for i in range(per)]
    docs = spark.createDataFrame([*rows, (None, "en1 en2", "en"), (None, None, None), (None, "xx1", "xx")], "doc_id long, text string, lang string")
    return docs, docs.filter("doc_id IS NOT NULL").select("doc_id")


def test_documents_of_a_domain_without_a_weight_stay(spark):
    docs, labels = two_domains(spark)
    out = mixing.mixed(docs.selectExpr("*", "'x' AS mixed_chance"), labels, {"en": 0.8, "fr": 0.2})
    assert out.columns == ["doc_id", "text", "lang", "mixed_chance"]
    counts = {r.lang: (r.n, r.ids) for r in out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).collect()}
    assert counts["xx"] == (41, 40) and counts["fr"][1] == 40 and counts["en"][1] == 40 and counts["en"][0] > 120
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    copies = sorted((r.doc_id or -1, r.copies) for r in mixing.mixture(docs, labels, {"en": 0.8, "fr": 0.2}).collect())
    assert sum(c for _, c in copies) == out.count() and min(c for _, c in copies) >= 1


def test_targets_that_cannot_be_met_are_an_error(spark):
    docs, labels = two_domains(spark)
    with pytest.raises(ValueError, match="weight of zero"):
        mixing.mixture(docs, labels, {"en": 1.0, "fr": 0.0})
    gone = mixing.mixture(docs, labels, {"en": 1.0, "fr": 0.0}, total=500.0).join(docs.select("doc_id", "lang"), "doc_id")
    assert {r.lang for r in gone.filter("copies = 0").collect()} >= {"fr"}
    # Two domains of the same documents cannot have different parts.
    same = spark.createDataFrame([(i, "a b c", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="not met"):
        mixing.mixture(same, same.select("doc_id"), {"en": 0.9, "fr": 0.1})


def test_mixing_on_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(4,), (None,), (7,), (10 ** 9,)], "doc_id long")
    odd = nasty(spark, docs)
    out = mixing.mixture(odd, labels, {"en": 1.0})
    assert out.count() == odd.count()
    assert mixing.mixed(odd, labels, {"en": 1.0}).columns == odd.columns
    assert mixing.mixture(odd, labels.limit(0), {"en": 1.0}).filter("rate = 1").count() == odd.count()
    assert mixing.mixture(odd, labels, {"xx": 1.0}).filter("rate = 1").count() == odd.count()
    assert mixing.mixture(empty, labels, {"en": 1.0}).count() == 0 and mixing.mixed(empty, labels, {"en": 1.0}).count() == 0


def test_expectation_maximisation_finds_the_labellers_accuracies():
    rng = np.random.default_rng(12)
    good = rng.random(40000) < 0.7
    right = np.array([0.95, 0.85, 0.7, 0.6])
    votes = np.stack([np.where(rng.random(len(good)) < 0.6, np.where((rng.random(len(good)) < p) == good, 1, -1), 0) for p in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float), least=1e-6)
    assert abs(model.prior - 0.7) < 0.05
    assert np.allclose(model.given[:, 1, 1], right, atol=0.06) and np.allclose(model.given[:, 0, 0], right, atol=0.06)


def test_quality_on_held_out_labels(spark):
    docs, labels = queries.documents(spark, "/root/testdata/sf0.1"), queries.documents(spark, "/root/testdata/sf0.1", "labels")
    model = quality.train(docs, labels.filter("doc_id % 4 > 0"))
    rows = quality.scored(docs, model).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    # Some 330 toxic documents in four languages to learn from.
    assert np.mean(clean) > 0.97 and np.mean(toxic) < 0.05 and np.mean(poor) < 0.06


def test_quality_on_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (4, 1, 0), (None, None, None), (10 ** 9, 0, 1)], "doc_id long, quality int, toxic int")
    odd = nasty(spark, docs)
    got = quality.quality(odd, labels).collect()
    assert len(got) == odd.count()
    assert quality.quality(odd, labels.limit(0)).count() == odd.count()
    assert quality.accepted(odd, labels).columns == odd.columns
    assert quality.quality(empty, labels).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    from airq.llm.shared import written

    docs = queries.documents(spark, SF)
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(written(stage(spark, held[-1], SF)))
    return held


def test_pipeline_stages_act_on_what_was_kept(spark, stages):
    docs, good, single, clean, mixed, ids = stages
    for frame in (good, single, clean, mixed):
        assert frame.columns == docs.columns
    labels = queries.documents(spark, SF, "labels").filter("quality = 1 AND toxic = 0")
    n = docs.join(labels, "doc_id").count()
    assert good.join(labels, "doc_id").count() > 0.97 * n
    text = {r.doc_id: r.text for r in good.collect()}
    from airq.llm.simhash import fingerprint
    from llm.test_dedup import brute_components

    label = brute_components([fingerprint(t) for t in text.values()])
    least = {}
    for i, c in zip(text, label):
        least[c] = min(i, least.get(c, i))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    bench = [(r.item_id, r.text) for r in queries.documents(spark, SF, "benchmark").collect()]
    # The passages of these documents are whole items.
    items = [f" {' '.join(words_of(text))} " for _, text in bench]
    leaks = {r.doc_id: any(i in f" {' '.join(words_of(r.text))} " for i in items) for r in single.collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, leak in leaks.items() if not leak)
    assert mixed.select("doc_id").distinct().count() == clean.count() and mixed.count() > clean.count()
    assert ids.count() == mixed.count()
    assert ids.agg({"n_tokens": "sum"}).first()[0] == ids.orderBy("start", ascending=False).selectExpr("start + n_tokens").first()[0]


def test_run_returns_what_the_stages_return(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))
