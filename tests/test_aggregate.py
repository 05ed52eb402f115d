from decimal import Decimal

import pytest
from plan_text import plan_of

from millrace.operators.aggregate import aggregate
from millrace.spec import MetricSpec, SpecError


@pytest.fixture
def sales(spark):
    return spark.sql("""
        select * from values ('a', 1, cast(1.10 as decimal(38,2))), ('a', null, 2.25), (null, 5, null), (null, 7, 3)
        as t(g, n, d)""")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_groups_and_null_handling(sales):
    df = aggregate(sales, ["G"], [MetricSpec("n", "SUM"), MetricSpec("n", "COUNT"), MetricSpec("*", "COUNT"),
                                  MetricSpec("d", "AVG"), MetricSpec("d", "MIN"), MetricSpec("d", "max", "Top")])
    assert df.columns == ["g", "n_sum", "n_count", "row_count", "d_avg", "d_min", "top"]
    assert rows(df) == [
        ("a", 1, 1, 2, Decimal("1.675000"), Decimal("1.10"), Decimal("2.25")),
        (None, 12, 2, 2, Decimal("3.000000"), Decimal("3.00"), Decimal("3.00")),
    ]
    assert dict(df.dtypes)["n_sum"] == "bigint"


def test_global_aggregate_of_nothing_is_one_row(sales):
    df = aggregate(sales.filter("false"), [], [MetricSpec("*", "COUNT"), MetricSpec("n", "SUM")])
    assert rows(df) == [(0, None)]


def test_mistakes(sales):
    for group, metric in ((["zz"], MetricSpec("n", "SUM")), ([], MetricSpec("zz", "SUM")), ([], MetricSpec("g", "SUM")),
                          ([], MetricSpec("g", "AVG"))):
        with pytest.raises(SpecError):
            aggregate(sales, group, [metric])
    with pytest.raises(SpecError):
        aggregate(sales, ["g"], [])


def test_groups_combine_before_the_shuffle(sales):
    plan = plan_of(aggregate(sales, ["g"], [MetricSpec("n", "SUM"), MetricSpec("d", "MAX")]))
    assert "partial_sum" in plan and "partial_max" in plan
