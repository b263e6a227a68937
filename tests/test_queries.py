"""Every registered core query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from loomspark.plans import catalogue
from loomspark.sources.tables import TABLES

DIR = os.environ.get("LOOMSPARK_TEST_DIR", "/root/testdata/sf0.001")
CORE = catalogue.load()
#: Compared by their own tests.
NO_SQL = set(CORE.functions()) - set(CORE.oracles())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(CORE.oracles()))
def test_query(spark, duck, name):
    df = CORE.functions()[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(CORE.oracles()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_registers_every_query_once():
    import __spark_entry__ as entry

    assert set(CORE.functions()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert said.returncode == 0 and int(said.stdout) >= len(CORE.functions()), said.stderr
