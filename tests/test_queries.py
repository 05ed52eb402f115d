import pytest
from compare import connect, difference
from plan_text import plan_of

import __spark_entry__ as entry_points

QUERIES, SQL, OWN = entry_points.queries(), entry_points.oracle_sql(), list(entry_points.OWN)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(SQL) <= set(QUERIES) and not [n for n in OWN if n not in SQL]


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, duck, SQL[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["segment", "status", "revenue", "average", "row_count"] and df.count() > 0
