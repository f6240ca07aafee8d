"""Masks of the decontamination on items of every short length."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from airq.llm import decontam


@pytest.mark.parametrize("n", range(decontam.LEAST, decontam.STRETCH + 1))
def test_masks_fit_whatever_tokens_of_a_short_item_are_replaced(n):
    replaced = n - next(a for a in range(n + 1) if a >= decontam.AGREE * n)
    for bad in itertools.combinations(range(n), replaced):
        assert any(not {o + p for p in m} & set(bad) for m in decontam.MASKS for o in range(n - m[-1])), bad


def test_an_item_of_eight_with_its_fourth_token_replaced_is_found(spark):
    docs = spark.createDataFrame([(1, "x y a b c other e f g h z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    (row,) = decontam.contaminated(docs, items).collect()
    assert row.item_ids == [7] and row.agreeing == 7 and not row.kept


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_short_items_are_found_word_for_word_in_their_own_column(spark, block_bytes):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 2, 3])]
    items += [(20, None), (21, " . "), (22, "A, b!"), (None, "a b")]
    docs = [(i, rng.choice([" ", "-", ".\n"]).join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    docs += [(500, None), (501, ""), (500, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    tokens = lambda t: " ".join(re.findall("[a-z]+", (t or "").lower()))
    want = {i: sorted({j for j, t in items if j is not None and tokens(t) and f" {tokens(t)} " in f" {tokens(d)} "}) for i, d in docs if i < 500}
    got = decontam.contaminated(df, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(docs) and all(r.kept and r.agreeing == 0 and not r.item_ids for r in got)
    assert {r.doc_id: r.short_item_ids for r in got if r.doc_id < 500} == want and sum(map(len, want.values())) > 100


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_rows_go_by_their_own_text_and_do_not_move(spark, block_bytes):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, "clean"), (None, item), (None, None), (2, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "other words of an item that is nowhere to be found")], "item_id long, text string")
    kept = decontam.decontaminated(docs.selectExpr("*", "'x' AS row"), bench, block_bytes=block_bytes)
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "clean", "x"), (2, "one two three", "x"), (None, None, "x")]
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
