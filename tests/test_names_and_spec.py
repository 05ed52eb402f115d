import re

import pytest
from hypothesis import given, strategies as st

from millrace.functions.names import safe_name, safe_names
from millrace.spec import (
    ColumnSpec, ComputedSpec, FilterSpec, JobSpec, JoinSpec, MetricSpec, SpecError, TableSpec,
)


@pytest.mark.parametrize("written, name", [
    ("Order ID", "order_id"), ("Unit Price ($)", "unit_price"), (" (ID) ", "id"), ("", "col"), ("***", "col"),
    ("Größe", "gr__e"), ("a\tb", "a_b"), ("__x__", "x"),
])
def test_safe_name(written, name):
    assert safe_name(written) == name


@given(st.text(max_size=20))
def test_safe_name_is_always_a_plain_identifier(text):
    name = safe_name(text)
    assert re.fullmatch(r"[a-z0-9_]+", name)
    assert safe_name(name) == name


def test_colliding_header_raises():
    with pytest.raises(ValueError, match="order_id"):
        safe_names(["Order ID", "order-id"])


def test_unknown_type_counts_as_text():
    assert ColumnSpec("a", "MONEY").kind == "TEXT"


@pytest.mark.parametrize("make", [
    lambda: FilterSpec("a", "~", "x"),
    lambda: FilterSpec(" ", "=", "x"),
    lambda: JoinSpec("t", "a", "b", "FULL"),
    lambda: JoinSpec("", "a", "b"),
    lambda: MetricSpec("a", "MEDIAN"),
    lambda: MetricSpec("*", "SUM"),
    lambda: ComputedSpec("x", ""),
    lambda: ComputedSpec("x", "1; drop table t"),
    lambda: ComputedSpec("x", "pg_sleep(1)"),
    lambda: ComputedSpec("x", "exec('a')"),
    lambda: TableSpec("t", [ColumnSpec("a"), ColumnSpec("b", output_name="A")]),
    lambda: TableSpec("t", joins=[JoinSpec("r", "a", "b"), JoinSpec("r", "a", "c")]),
    lambda: TableSpec("t", joins=[JoinSpec("t", "a", "b")]),
    lambda: JobSpec([]),
])
def test_mistakes_raise(make):
    with pytest.raises(SpecError):
        make()


def test_forbidden_words_only_count_as_words():
    assert ComputedSpec("x", "created_at || dropped || executed").output == "x"


def test_metric_names():
    assert MetricSpec("Price", "avg").output == "price_avg"
    assert MetricSpec("*", "COUNT").output == "row_count"
    assert MetricSpec("", "COUNT", "N Rows").output == "n_rows"


def test_spec_from_saved_json():
    job = JobSpec.from_dict({
        "tables": [{
            "table": "Orders", "columns": [{"name": "ID", "type": "INTEGER"}],
            "filters": [{"column": "id", "operator": ">", "value": "1"}],
            "joins": [{"table": "c", "left_col": "a", "right_col": "b"}],
            "computed_cols": [{"name": "x", "expression": "upper(a)"}],
            "group_by": ["id"], "metrics": [{"column": "*", "fn": "COUNT"}],
        }],
        "custom_sql": None,
    })
    table = job.tables[0]
    assert (table.name, table.kept[0].output, table.joins[0].how) == ("orders", "id", "LEFT")
    assert table.computed[0].expression == "upper(a)"
    with pytest.raises(SpecError, match="colour"):
        TableSpec.from_dict({"table": "t", "colour": 1})
    with pytest.raises(SpecError, match="typ"):
        TableSpec.from_dict({"table": "t", "columns": [{"name": "a", "typ": "TEXT"}]})
