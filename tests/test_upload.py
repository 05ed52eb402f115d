import datetime

import pytest
from plan_text import plan_of

from millrace.sinks.versions import read_table
from millrace.operators.clean import clean
from millrace.plans.script import read_script, run_script
from millrace.plans.upload import load_csv
from millrace.plans.job import run_job
from millrace.spec import ColumnSpec, JobSpec, MetricSpec, TableSpec

AT = datetime.datetime(2024, 5, 6)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    lines = "".join(f'{i},{i}.5,"2024-01-{i % 28 + 1:02}",\n' for i in range(1500))
    (tmp_path / "in/a.csv").write_text("Order ID,Price ($),Day,Empty\n" + lines)
    (tmp_path / "in/b.csv").write_text("Order ID,Price ($),Day,Empty\nlast,1,2024-02-02,\n")
    return tmp_path


def profile(upload):
    return [tuple(r) for r in upload.columns.collect()]


def test_whole_load(spark, folder):
    done = load_csv(spark, str(folder / "in"), "My Orders", str(folder / "raw"), as_of=AT)
    assert (done.table, done.rows, done.total_rows, done.sampled) == ("my_orders", 1501, 1501, False)
    assert done.raw.columns == ["order_id", "price", "day", "empty", "uploaded_at"]
    # The odd value is far from the head, and in another file.
    assert profile(done) == [
        (0, "order_id", "TEXT", ["0", "1", "2"]), (1, "price", "NUMERIC", ["0.5", "1.5", "2.5"]),
        (2, "day", "DATE", ["2024-01-01", "2024-01-02", "2024-01-03"]), (3, "empty", "TEXT", []),
    ]


def test_sampled_load(spark, folder):
    done = load_csv(spark, str(folder / "in"), "t", str(folder / "raw"), first_rows=1000, sample_values=3)
    assert (done.rows, done.total_rows, done.sampled) == (1000, 1501, True)
    assert [p[2] for p in profile(done)] == ["INTEGER", "NUMERIC", "DATE", "TEXT"]
    assert {r["order_id"] for r in done.raw.collect()} == {str(i) for i in range(1000)}


def test_nothing_to_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no data rows"):
        load_csv(spark, str(tmp_path / "in"), "t", str(tmp_path / "raw"))


def test_the_head_goes_on_in_later_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(["", "n,source_id\n", "n,source_id\n0,a\n1,b\n", "n,source_id\n2, c \n", "n,source_id\n3,d\n4,e\n"]):
        (tmp_path / f"in/{i}.csv").write_text(text)
    done = load_csv(spark, str(tmp_path / "in"), "t", str(tmp_path / "raw"), first_rows=4)
    assert sorted((r["n"], r["source_id"]) for r in done.raw.collect()) == [("0", "a"), ("1", "b"), ("2", "c"), ("3", "d")]
    assert (done.rows, done.total_rows) == (4, 5)
    done = load_csv(spark, str(tmp_path / "in"), "t", str(tmp_path / "raw2"))
    assert done.rows == 5 and profile(done)[0] == (0, "n", "INTEGER", ["0", "1", "2"])


def test_stored_tables_are_pruned_by_partition(spark, raw, tmp_path):
    spec = TableSpec("t", [ColumnSpec("day", "DATE"), ColumnSpec("v", "INTEGER")])
    tables = {"t": raw("day v", ("2024-01-01", "1"), ("2024-01-02", "2"))}
    run_job(spark, JobSpec([spec]), tables, store_at=str(tmp_path), partition_by={"t": ["day"]})
    df = spark.table("clean_t").filter("day = date'2024-01-02'")
    assert "PartitionFilters: [isnotnull(day" in plan_of(df)
    assert [tuple(r) for r in df.collect()] == [(datetime.date(2024, 1, 2), 2)] and spark.table("clean_t").columns == ["day", "v"]


def test_from_files_to_stored_views_and_snapshots(spark, folder):
    raw = load_csv(spark, str(folder / "in/a.csv"), "orders", str(folder / "raw"), as_of=AT).raw
    spec = TableSpec("orders", [ColumnSpec("Order ID", "INTEGER"), ColumnSpec("day", "DATE")], group_by=["day"],
                     metrics=[MetricSpec("order_id", "MAX"), MetricSpec("*", "COUNT")])
    out = run_job(spark, JobSpec([spec]), {"orders": raw}, store_at=str(folder / "clean"), export_to=str(folder / "csv"),
                  at=AT)
    assert read_table(spark, str(folder / "clean/orders")).exceptAll(clean(spec, {"orders": raw})).isEmpty()
    snapshot = spark.read.csv(out["analytics_orders"], header=True)
    assert sorted(tuple(r) for r in snapshot.collect())[0] == ("2024-01-01", "1484", "54")


def test_script_from_a_file(spark, tmp_path):
    (tmp_path / "s.sql").write_text("create or replace temp view from_file as select 'a;\nb' as t;\n")
    run_script(spark, read_script(spark, str(tmp_path / "s.sql")))
    assert spark.table("from_file").first()["t"] == "a;\nb"
