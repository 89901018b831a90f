"""Every registered query beside its SQL, and rows at least from the others."""

import pytest

from sparkloom.plans import catalog_graph, catalog_review, catalog_rows, catalog_state, catalog_store, catalog_text  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES

from .compare import connect, rows

SF = "/root/testdata/sf0.001"
#: Queries whose result on this data is known to be empty.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    got = rows(df.collect(), df.columns)
    assert got == rows(want.fetchall(), want.columns)
    assert got[1] or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
