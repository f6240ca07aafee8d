"""The SQL of the package against its queries, and the guard around the package."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT

from airq.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    con.sql(queries.oracle_sql()[name]).create_view("checked")
    want = con.execute("SELECT * FROM checked")
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == rows and rows


BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {blocked!r} or name.startswith("airq.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
assert len(entry.queries()) == len(entry.oracle_sql()) > 50 and "pipeline" not in entry.queries()
"""


@pytest.mark.parametrize("blocked", [("airq.llm",), ("airq.llm", "corpus_pipeline")])
def test_entry_works_without_the_package(blocked):
    subprocess.run([sys.executable, "-c", BLOCK.format(blocked=blocked)], cwd=ROOT, check=True)


def test_every_dealt_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
