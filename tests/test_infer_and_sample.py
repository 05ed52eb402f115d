import re

import pytest
from plan_text import plan_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.operators.infer import infer_types
from millrace.operators.sample import column_samples, file_order, preview
from millrace.sources.csv import read_raw

CASES = [
    (["0", "1", "1"], "INTEGER"), (["yes", "No"], "BOOLEAN"), (["true", "0"], "BOOLEAN"), (["5."], "NUMERIC"),
    ([".5"], "TEXT"), (["+5"], "TEXT"), (["1e5"], "TEXT"), (["3000000000"], "INTEGER"), (["2024-02-30"], "DATE"),
    (["2024-01-01T10:00:00Z", "2024-01-01 10:00"], "TIMESTAMP"), (["2024-01-01", "2024-01-01 10:00"], "TEXT"),
    (["", "  ", None], "TEXT"), (["1", "2", "x"], "TEXT"), (["-3", "4.5", " "], "NUMERIC"), ([" 7 ", "\t8"], "INTEGER"),
    (["1", "2.0", "yes"], "TEXT"), (["0", "no"], "BOOLEAN"),
]


def table(spark, columns):
    height = max(map(len, columns))
    padded = [c + [None] * (height - len(c)) for c in columns]
    schema = ", ".join(f"c{i} STRING" for i in range(len(columns)))
    return spark.createDataFrame([tuple(c[r] for c in padded) for r in range(height)], schema)


def test_cases(spark):
    found = infer_types(table(spark, [values for values, _ in CASES])).orderBy("ordinal").collect()
    assert [r["type"] for r in found] == [kind for _, kind in CASES]
    assert [r["column"] for r in found] == [f"c{i}" for i in range(len(CASES))]


VALUES = st.sampled_from(["0", "1", "12", "-4", "5.", "1.25", "x", "2024-01-01", "2024-01-01 10:00", "yes", "NO",
                          "true", "", " ", None, "1e5", "-", "01"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(VALUES, min_size=1, max_size=3), min_size=6, max_size=6))
def test_order_and_blanks_do_not_matter_and_odd_text_widens(spark, columns):
    def kinds(of):
        return [r["type"] for r in infer_types(table(spark, of)).orderBy("ordinal").collect()]

    known = kinds(columns)
    assert kinds([[*reversed(c), " ", None] for c in columns]) == known
    assert kinds([[*c, "?"] for c in columns]) == ["TEXT"] * len(columns)
    assert all(k in ("TEXT", w) or w == "INTEGER" and k in ("NUMERIC", "BOOLEAN") for c, w, k in zip(columns, kinds([c[:1] for c in columns]), known) if c[0] and c[0].strip())


def test_one_pass_over_the_table(spark, tmp_path):
    table(spark, [["1"], ["x"], ["2024-01-01"]]).write.parquet(str(tmp_path / "t"))
    plan = plan_of(infer_types(spark.read.parquet(str(tmp_path / "t"))))
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1 and "Python" not in plan


def test_all_rows_count_unless_only_samples_are_asked_for(spark):
    df = spark.range(200).select(F.when(F.col("id") == 199, "x").otherwise(F.col("id").cast("string")).alias("c"),
                                 F.lit(" ").alias("blank"), "id")
    text = df.select("c", "blank")
    assert infer_types(text).first()["type"] == "TEXT"
    sampled = infer_types(df.select("c", "blank", "id"), [F.col("id")], sample_values=3)
    assert [r["type"] for r in sampled.orderBy("ordinal").collect()] == ["INTEGER", "TEXT", "INTEGER"]


def test_column_samples_are_the_first_non_empty_values(spark):
    df = spark.range(100).select(
        "id", F.when(F.col("id") % 2 == 1, F.col("id").cast("string")).otherwise(" ").alias("odd"),
        F.when(F.col("id") >= 50, "late").alias("late")).repartition(7)
    found = {r["column"]: r["samples"] for r in column_samples(df, [F.col("id")]).collect()}
    assert found == {"id": ["0", "1", "2"], "odd": ["1", "3", "5"], "late": []}


def test_preview(spark):
    df = spark.range(2500).repartition(5)
    head = preview(df, [F.col("id")])
    got = head.collect()
    assert [r["id"] for r in got] == list(range(1000))
    assert {(r["total_rows"], r["sampled"]) for r in got} == {(2500, True)}
    assert "TakeOrderedAndProject" in plan_of(head)
    few = preview(df.filter("id < 3"), [F.col("id")]).collect()
    assert [(r["id"], r["total_rows"], r["sampled"]) for r in few] == [(0, 3, False), (1, 3, False), (2, 3, False)]


def test_file_order_is_the_order_of_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(500)))
    (tmp_path / "b.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(500, 900)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = read_raw(spark, str(tmp_path), multi_line=False)
        got = [r["n"] for r in preview(df, file_order(), rows=700).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [str(i) for i in range(700)]


def test_many_columns_cost_one_expression(spark):
    wide = spark.range(100).selectExpr(*[f"cast(id + {i} as string) as c{i}" for i in range(400)])
    types = infer_types(wide)
    assert plan_of(types).count("RLIKE") <= 8
    assert [r["type"] for r in types.collect()] == ["INTEGER"] * 400


def test_a_table_without_rows_has_text_columns(raw):
    assert [tuple(r) for r in infer_types(raw("a b")).collect()] == [(0, "a", "TEXT"), (1, "b", "TEXT")]


def test_text_of_unreadable_payloads_is_kept(spark):
    from millrace.sources.payload import expand_payload

    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{oops"), (3, None)], "id INT, p STRING")
    got = expand_payload(df, "p", "k INT", unreadable="bad").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 3, None), (2, None, "{oops"), (3, None, None)]


def test_profiles_of_files_merge(spark, tmp_path):
    """Adding one file reads one; the result is that of looking at all rows."""
    from millrace.operators.profile import FolderProfile
    from millrace.sources.csv import read_raw

    cells = {"a": ["1", "-2", ""], "b": ["1.5", "2", "x"], "c": ["2024-01-01", "", "2024-02-30"], "d": ["yes", "0", "no"], "e": ["", "  ", '"q, r"']}
    folder = tmp_path / "in"

    def put(name, turn, rows):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        lines = [",".join(v[(i + turn) % 3 if i % 40 == 39 else (i + turn) % 2] for v in cells.values()) for i in range(rows)]
        (folder / name).write_text("\n".join([",".join(cells), *lines]) + "\n")

    def all_rows():
        raw = read_raw(spark, str(folder), recursive=True)
        return [tuple(r) for r in infer_types(raw).collect()], raw.count()

    for i in range(6):
        put(f"{i % 2}/f {i}.csv", i, 20 + i)
    profile = FolderProfile(spark, str(folder), str(tmp_path / "kept"))
    assert profile.refresh() == 6 and profile.refresh() == 0
    put("new.csv", 1, 80)
    put("1/f 1.csv", 2, 33)
    (folder / "0/f 2.csv").unlink()
    assert profile.refresh() == 2
    found = profile.columns().orderBy("ordinal").collect()
    types, n = all_rows()
    assert [(r["ordinal"], r["column"], r["type"]) for r in found] == types and {r["rows"] for r in found} == {n}
    assert found[0]["samples"] == ["1", "-2", "1"] and found[4]["samples"] in ([], ["q, r"])
