"""A third of all rows on one key: the join splits it, the groups combine first."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import tuples

import airq
from inspect_plans import final_plan
from airq.sources import tables

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_tables(spark, folder, n=30000):
    """Every third line item belongs to one order and one part."""
    items = spark.range(0, n, 1, 6).selectExpr(
        "if(id % 3 = 0, 0L, id % 500) AS l_orderkey", "if(id % 3 = 0, 0L, id % 700) AS l_partkey",
        "cast(id % 7 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity",
        "cast((id * 37) % 100000 AS double) AS l_extendedprice", "0.05D AS l_discount",
        "0.01D AS l_tax", "timestamp_ntz'1996-01-01' + make_interval(0, 0, 0, cast(id % 900 AS int)) AS l_shipdate",
    )
    frames = {
        "lineitem": items,
        "orders": spark.range(500).selectExpr("id AS o_orderkey", "id % 60 AS o_custkey"),
        "customer": spark.range(60).selectExpr(
            "id AS c_custkey", "cast(id % 5 AS int) AS c_nationkey", "concat('S', id % 3) AS c_mktsegment"
        ),
        "nation": spark.range(5).selectExpr("cast(id AS int) AS n_nationkey", "concat('N', id) AS n_name"),
        "part": spark.range(700).selectExpr(
            "id AS p_partkey", "concat('B', id % 9) AS p_brand", "'T' AS p_type"
        ),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_hot_join_key_is_split(spark, tmp_path, small_limits):
    folder = write_tables(spark, tmp_path / "skewed")
    shuffled = tables.cleaned_readings(spark, folder)
    plan = final_plan(shuffled)
    joins = [line for line in plan if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert any("skew=true" in line for line in joins), joins
    rows = sorted(tuples(shuffled), key=str)
    for key in SETTINGS:
        spark.conf.unset(key)
    assert rows == sorted(tuples(tables.cleaned_readings(spark, folder)), key=str)
    assert len(rows) == 30000


def shuffled_rows(node):
    """Rows written by every exchange of a finished plan."""
    name, found = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(node.executedPlan())
    if "QueryStage" in name:
        return shuffled_rows(node.plan())
    if name == "Exchange":
        found.append(node.metrics().apply("shuffleRecordsWritten").value())
    children = node.children()
    for i in range(children.size()):
        found += shuffled_rows(children.apply(i))
    return found


def test_hot_groups_send_one_row_per_task(spark):
    """Shuffle size depends on the groups, not on the rows in them."""
    day = dt.date(2023, 1, 1)
    hot = spark.range(0, 200_000, 1, 4).selectExpr(
        f"if(id % 3 = 0, date'{day}', date'{day}' + cast(id % 60 AS int)) AS date",
        "if(id % 3 = 0, 'hot', concat('s', id % 20)) AS state", "cast(id % 500 AS double) AS aqi_value",
    )
    # Four tasks, 21 states and at most 60 days: what is shuffled follows these.
    for df, most in ((airq.state_ranking(hot), 4 * 21 * 2), (airq.monthly_mean(hot), 4 * 60)):
        df.collect()
        assert 0 < sum(shuffled_rows(df._jdf.queryExecution().executedPlan())) <= most * 2
    assert len(tuples(airq.monthly_mean(hot))) == 3
    means = dict((s, m) for s, m, _ in tuples(airq.state_ranking(hot)))
    assert means["hot"] == pytest.approx(
        sum(i % 500 for i in range(0, 200_000, 3)) / len(range(0, 200_000, 3))
    )
