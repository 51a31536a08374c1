"""Every registered query against its SQL on the smallest tables, where they are there."""

import os

import pytest

from quillstone.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def rows(columns, values):
    shown = lambda x: "null" if x is None else f"{x:.6f}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert got == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
