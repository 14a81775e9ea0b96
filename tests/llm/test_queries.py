"""Registered queries: those with SQL against it, all for plans without joins of everything with everything."""

import pytest

from tests import compare
from themeloom.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    connection = compare.connect(FOLDER)
    cursor = connection.execute(catalog.SQL[name])
    names = [item[0] for item in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = [names[i] for i in order], compare._sorted([tuple(row[i] for i in order) for row in cursor.fetchall()])
    assert compare.difference(compare.frame_rows(df), expected) is None


def test_registered():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES if name.startswith("op")) == list(range(1, 14))
