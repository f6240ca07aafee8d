"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import ROOT  # noqa: F401
from pyspark.sql import types as T

import __spark_entry__ as entry
from airq.plans import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {T.StringType: "VARCHAR", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
         T.DoubleType: "DOUBLE", T.DateType: "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=str)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())
    assert set(oracle.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    # A statement must do as a view as well.
    want = duck.sql(oracle.oracle_sql()[name])
    want.create_view("checked", replace=True)
    want = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    types = {c[0]: str(c[1]) for c in want.description}
    assert {f.name: TYPES[type(f.dataType)] for f in got.schema.fields} == types
    assert by_name(map(tuple, got.collect()), got.columns) == by_name(want.fetchall(), columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month_start", "mean_aqi"]
    assert df.count() > 12
