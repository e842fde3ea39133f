"""Every query against its SQL in DuckDB at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from siftline.plans.queries import ORACLES, QUERIES, entry

SF = os.environ.get("SIFTLINE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_names():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    found = tables.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr) == want


def test_entry(spark):
    assert entry(spark, SF).count() > 0
