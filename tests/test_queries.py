"""Every registered telemetry query returns the rows of its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from sentrymill.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return c


def plain(df):
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(tuple(map(cell, r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_import_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()) >= 80, len(e.oracle_sql()) >= 80)"], cwd=root, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "True"], said.stderr[-500:]
