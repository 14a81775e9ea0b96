"""Every registered query against its SQL, and plan shapes that must not appear."""

import os

import pytest

from tests import compare
from themeloom.plans import catalog

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, connection, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = compare.frame_rows(df)
    if name in catalog.SQL:
        assert compare.difference(got, compare.sql_rows(connection, name)) is None
    else:
        assert got[1]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
