"""The median by radix selection equals the plain one, whatever the distribution."""

from __future__ import annotations

import math
import random
import statistics
import struct
from collections import Counter, defaultdict

import pytest

from airq.functions import median
from airq.functions.median import median_of_counts, ordered_bits

rng = random.Random(5)
GROUPS = {
    "one": [7.0],
    "two": [1.0, 2.0],
    "even": [1.0, 2.0, 3.0, 10.0],
    "equal": [5.0] * 9,
    "hot": [100.0] * 400 + [float(v) for v in range(100)],
    "ints": [float(rng.randint(0, 500)) for _ in range(3001)],
    "many": [rng.uniform(-1e3, 1e3) for _ in range(5000)],
    "outlier": [rng.random() for _ in range(2000)] + [1e12],
    "halves": [0.0] * 50 + [1000.0] * 50,
    "negative": [-5.5, -4.5, -1.0],
    "zeros": [0.0, -0.0, -5e-324, 5e-324, 0.0],
    "wide": [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-1060, 1000) for _ in range(3000)],
    "close": [100.0 * (1 + i * 2.0 ** -52) for i in range(1200)],
}


def counts(spark):
    rows = [(k, v, n) for k, values in GROUPS.items() for v, n in Counter(values).items()]
    return spark.createDataFrame(rows, "k string, v double, n bigint")


def test_per_group(spark):
    got = {r.k: r.median for r in median_of_counts(counts(spark), "v", "n", ["k"]).collect()}
    assert got == {k: statistics.median(v) for k, v in GROUPS.items()}


@pytest.mark.parametrize("group", GROUPS)
def test_whole(spark, group):
    got = median_of_counts(counts(spark).filter(f"k = '{group}'"), "v", "n").collect()
    assert [r.median for r in got] == [statistics.median(GROUPS[group])]


def test_nothing_counted(spark):
    empty = counts(spark).limit(0)
    assert [r.median for r in median_of_counts(empty, "v", "n").collect()] == [None]
    assert median_of_counts(empty, "v", "n", ["k"]).collect() == []


def test_two_keys(spark):
    groups = defaultdict(list)
    for _ in range(4000):
        groups[rng.randint(0, 3), rng.choice("ab")].append(float(rng.randint(0, 40)))
    rows = [(a, b, v, n) for (a, b), vs in groups.items() for v, n in Counter(vs).items()]
    df = spark.createDataFrame(rows, "a int, b string, v double, n bigint")
    got = {(r.a, r.b): r.m for r in median_of_counts(df, "v", "n", ["a", "b"], "m").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def last_stage_rows(spark, df):
    """Rows that the last window of the median puts in order, in one task."""
    plan = median_of_counts(df, "v", "n")
    plan.collect()
    node = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" in node
    status = plan._jdf.queryExecution().executedPlan()
    return max(windowed(status))


def windowed(node):
    """Input rows of all exchanges to a single partition."""
    found = [0]
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return windowed(node.executedPlan())
    if "QueryStage" in name:
        return windowed(node.plan())
    if name == "Exchange" and "SinglePartition" in node.toString().splitlines()[0]:
        found.append(node.metrics().apply("shuffleRecordsWritten").value())
    children = node.children()
    for i in range(children.size()):
        found += windowed(children.apply(i))
    return found


def test_an_outlier_does_not_crowd_the_last_task(spark):
    plain = spark.range(400_000).selectExpr("CAST(id AS DOUBLE) AS v", "1L AS n")
    outlier = plain.unionByName(spark.sql("SELECT 1e15D AS v, 1L AS n"))
    without, having = last_stage_rows(spark, plain), last_stage_rows(spark, outlier)
    # A step puts one row per bucket of a step in order, some thousands here.
    assert 0 < having <= without + 2 and without <= 20_000
    assert median_of_counts(outlier, "v", "n").first().median == 200_000.0


def test_bits_are_those_of_the_format_and_keep_the_order(spark):
    values = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, 0.1, 1e16, 8.98e307]
    values += [2.0 ** k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0 ** k, -1) for k in range(-1022, 1024, 5)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(3000)]
    values = [v for v in values if math.isfinite(v)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, code in spark.sql(ordered_bits("{df}", "v", "v"), df=df).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert code == (bits if v > 0 else -bits), v


def test_no_list_of_bounds_in_any_row(spark):
    plan = median_of_counts(counts(spark), "v", "n", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "array" not in plan


@pytest.mark.parametrize("first, second", [(52, 40), (60, 10)])
def test_every_step_decides(spark, monkeypatch, first, second):
    monkeypatch.setattr(median, "FIRST", first)
    monkeypatch.setattr(median, "SECOND", second)
    got = {r.k: r.median for r in median_of_counts(counts(spark), "v", "n", ["k"]).collect()}
    assert got == {k: statistics.median(v) for k, v in GROUPS.items()}
