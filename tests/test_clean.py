import datetime
from decimal import Decimal

import pytest
from plan_text import plan_of

from millrace.functions.cells import WHITESPACE, normalize_cells
from millrace.operators.clean import clean
from millrace.spec import ColumnSpec as Col
from millrace.spec import ComputedSpec, FilterSpec, JoinSpec, SpecError, TableSpec


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, raw, value, kind):
    return rows(clean(TableSpec("t", [Col("c", kind)]), {"t": raw("c", value)}))[0][0]


def test_cells_are_stripped_of_all_whitespace(raw):
    cells = [f"{w}x y{w}" for w in WHITESPACE] + ["", "   ", WHITESPACE, None]
    out = [r[0] for r in rows(normalize_cells(raw("c", *cells)))]
    assert out == ["x y"] * len(WHITESPACE) + [None] * 4
    assert [c.strip() or None for c in cells[:-1]] == out[:-1]


@pytest.mark.parametrize("value, kind, result", [
    ("  a b ", "TEXT", "a b"), ("\ta", "TEXT", "\ta"), (" x ", "MONEY", "x"),
    ("12", "INTEGER", 12), (" -7 ", "INTEGER", -7), (None, "INTEGER", None),
    ("-12.345", "NUMERIC", Decimal("-12.35")), ("12.345", "NUMERIC", Decimal("12.35")), ("1e3", "NUMERIC", Decimal("1000.00")),
    ("0.00499999999999999999999", "NUMERIC", Decimal("0.00")),
    ("123456789012345678901.5", "NUMERIC", Decimal("123456789012345678901.50")),
    ("2024-02-29", "DATE", datetime.date(2024, 2, 29)), ("2024-02-29 23:59:59", "DATE", datetime.date(2024, 2, 29)),
    ("2024-01-01T10:00:00Z", "TIMESTAMP", datetime.datetime(2024, 1, 1, 10)),
    ("2024-01-01 10:00:00+05", "TIMESTAMP", datetime.datetime(2024, 1, 1, 10)),
    ("2024-01-01 10:00", "TIMESTAMP", datetime.datetime(2024, 1, 1, 10)),
    ("on", "BOOLEAN", True), ("OFF", "BOOLEAN", False), ("tru", "BOOLEAN", True), (" Yes ", "BOOLEAN", True),
    ("0", "BOOLEAN", False), ("N", "BOOLEAN", False), ("of", "BOOLEAN", False),
])
def test_casts(spark, raw, value, kind, result):
    assert one(spark, raw, value, kind) == result


BAD = [("12.5", "INTEGER"), ("3000000000", "INTEGER"), ("x", "NUMERIC"), ("2024-02-30", "DATE"),
       ("x", "TIMESTAMP"), ("maybe", "BOOLEAN")]


@pytest.mark.parametrize("value, kind", BAD)
def test_bad_cells_fail(spark, raw, value, kind):
    with pytest.raises(Exception, match="CAST|CANNOT|NUMERIC|invalid"):
        one(spark, raw, value, kind)


@pytest.mark.parametrize("value, kind", BAD)
def test_bad_cells_fail_without_ansi_mode_too(spark, raw, value, kind):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="invalid"):
            one(spark, raw, value, kind)
        assert one(spark, raw, "7", "INTEGER") == 7
        assert one(spark, raw, None, kind) is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_select_rename_order(raw):
    spec = TableSpec("T", [Col("B", output_name="First One"), Col("a"), Col("c", include=False)],
                     computed=[ComputedSpec("Sum", "a || b")])
    df = clean(spec, {"t": raw("a b c", ("1", "2", "3"))})
    assert df.columns == ["first_one", "a", "sum"]
    assert rows(df) == [("2", "1", "12")]


def test_nothing_selected_keeps_everything(raw):
    df = raw("a b", ("1", " 2"))
    assert rows(clean(TableSpec("t"), {"t": df})) == [("1", " 2")]
    assert rows(clean(TableSpec("t", filters=[FilterSpec("a", "=", "2")]), {"t": df})) == []
    with pytest.raises(SpecError, match="share"):
        clean(TableSpec("t", joins=[JoinSpec("u", "a", "a")]), {"t": df, "u": df})


def test_unknown_names_raise(raw):
    tables = {"t": raw("a", "1")}
    with pytest.raises(SpecError, match="unknown table"):
        clean(TableSpec("u", [Col("a")]), tables)
    with pytest.raises(SpecError, match="no column"):
        clean(TableSpec("t", [Col("z")]), tables)
    with pytest.raises(SpecError, match="unknown column"):
        clean(TableSpec("t", [Col("a")], filters=[FilterSpec("z", "=", "1")]), tables)


def test_computed_scopes(raw):
    tables = {"t": raw("price qty", ("1.005", "3"), ("2.5", "4"))}
    columns = [Col("price", "NUMERIC"), Col("qty", "INTEGER", include=False)]
    text = ComputedSpec("text", "price || '*' || qty")
    total = ComputedSpec("total", "price * qty", over="typed")
    df = clean(TableSpec("t", columns, computed=[total, text]), tables)
    assert df.columns == ["price", "total", "text"]
    # The shown price is rounded, the computed total is not.
    assert rows(df.selectExpr("price", "cast(total as double)", "text")) == [
        (Decimal("1.01"), 3.015, "1.005*3"), (Decimal("2.50"), 10.0, "2.5*4")]


def test_computed_expressions_of_all_kinds(raw):
    tables = {"t": raw("a g", ("1", "x"), ("3", "x"), ("5", "y"))}
    df = clean(TableSpec("t", [Col("a", "INTEGER")], computed=[
        ComputedSpec("rank", "row_number() over (partition by g order by a desc)"),
        ComputedSpec("kind", "case when a > '2' then 'big' else 'small' end"),
    ]), tables)
    assert sorted(rows(df)) == [(1, 2, "small"), (3, 1, "big"), (5, 1, "big")]


def test_typed_scope_reaches_joined_tables(raw):
    tables = {"t": raw("k v", ("1", "10"), ("2", "20")), "r": raw("k w", ("1", "5"))}
    spec = TableSpec("t", [Col("k"), Col("v", "INTEGER")], joins=[JoinSpec("r", "k", "k")],
                     computed=[ComputedSpec("s", "v + coalesce(cast(r.w as int), 0)", over="typed")])
    assert sorted(rows(clean(spec, tables))) == [("1", 10, 15), ("2", 20, 20)]


FILTER_ROWS = [("1", "it's 50%", "1.10", "2024-01-01", "on"), ("2", r"a_b\c", "1.11", "2024-01-02", "off"),
               ("3", None, None, None, None)]


@pytest.mark.parametrize("column, operator, value, keys", [
    ("n", "=", "1.1", "1"), ("n", "=", "1.105", ""), ("n", "!=", "1.105", "12"), ("n", ">", "1.105", "2"),
    ("n", ">=", "1.105", "2"), ("n", "<", "1.105", "1"), ("n", "<=", "1.105", "1"), ("n", ">=", "1.11", "2"),
    ("n", "<", "1.11", "1"), ("n", "<=", "-5", ""), ("n", "IS NULL", "", "3"), ("n", "IS NOT NULL", "", "12"),
    ("t", "=", "it's 50%", "1"), ("t", "!=", "it's 50%", "2"), ("t", "LIKE", "'s", "1"), ("t", "LIKE", r"0\%", "1"),
    ("t", "LIKE", "a_b", "2"), ("t", "LIKE", "_", "12"), ("t", "LIKE", r"\_", "2"), ("t", "LIKE", r"b\\c", "2"),
    ("t", "LIKE", r"\a", "2"), ("t", "LIKE", "i%5", "1"), ("t", "LIKE", "", "12"),
    ("d", ">", "2024-01-01", "2"), ("d", "=", " 2024-01-01 ", "1"), ("b", "=", "yes", "1"), ("b", "!=", "true", "2"),
    ("id", ">=", "2", "23"), ("id", "=", "2", "2"),
    ("amount", "=", "1.1", "1"), ("flag", "=", "f", "2"), ("dropped", "=", "1.10", "1"),
])
def test_filters(raw, column, operator, value, keys):
    df = raw("id t amount d flag", *FILTER_ROWS).selectExpr("*", "amount as dropped")
    spec = TableSpec("x", [
        Col("id", "INTEGER"), Col("t"), Col("amount", "NUMERIC", "n"), Col("d", "DATE"),
        Col("flag", "BOOLEAN", "b"),
    ], filters=[FilterSpec(column, operator, value)])
    out = clean(spec, {"x": df})
    assert out.columns == ["id", "t", "n", "d", "b"]
    assert "".join(str(r[0]) for r in sorted(rows(out))) == keys


@pytest.mark.parametrize("column, operator, value", [
    ("id", "=", "1.5"), ("n", "=", "abc"), ("b", "=", "maybe"), ("id", "LIKE", "1"), ("n", "=", "NaN"),
])
def test_filter_values_must_fit_the_column(raw, column, operator, value):
    spec = TableSpec("x", [Col("id", "INTEGER"), Col("n", "NUMERIC"), Col("b", "BOOLEAN")],
                     filters=[FilterSpec(column, operator, value)])
    with pytest.raises(SpecError):
        clean(spec, {"x": raw("id n b", ("1", "1", "t"))})


def test_dropped_filter_column_keeps_its_type(raw):
    spec = TableSpec("x", [Col("id"), Col("n", "NUMERIC", include=False)], filters=[FilterSpec("n", ">", "9")])
    assert rows(clean(spec, {"x": raw("id n", ("a", "10"), ("b", "9"))})) == [("a",)]


def test_filters_reach_the_scan_of_a_stored_raw_table(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    normalize_cells(raw("a b c", (" x ", "1", "z"), ("y", "2", "z"))).write.parquet(path)
    spec = TableSpec("t", [Col("b", "INTEGER")], filters=[FilterSpec("a", "=", "x")])
    df = clean(spec, {"t": spark.read.parquet(path)})
    plan = plan_of(df)
    assert "EqualTo(a,x)" in plan and "c:string" not in plan
    assert rows(df) == [(1,)]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("kind", ["DATE", "TIMESTAMP"])
def test_times_are_taken_whole_or_not_at_all(spark, raw, ansi, kind):
    spec = TableSpec("t", [Col("v", kind)])
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for wrong in ("2024-01-01 garbage", "2024-01-01Tzzz", "2024", "2024-01"):
            with pytest.raises(Exception, match="(?i)invalid"):
                clean(spec, {"t": raw("v", wrong)}).collect()
        for right in ("2024-01-05", "2024-1-5", "2024-01-05 10:20:30", "2024-01-05T10:20:30.5Z", "2024-01-05 10:20:30+02:00"):
            assert str(clean(spec, {"t": raw("v", right)}).first()[0]).startswith("2024-01-05")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
