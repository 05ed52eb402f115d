import csv
import datetime
import glob
import logging
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.functions.cells import normalize_cells
from millrace.sinks.commits import CommitLog, Files
from millrace.sinks.export import export_csv
from millrace.sinks.tables import publish_curated, replace_raw
from millrace.sinks.versions import Versions, read_table
from millrace.sinks.views import create_view, store_table, view_name
from millrace.sources.csv import read_raw
from millrace.sources.files import FileManifest, land_files, landed, latest_file, list_files
from millrace.sources.jdbc import jdbc_options
from millrace.sources.payload import expand_payload, read_payloads
from millrace.streaming.landing import land_batch, land_new_files

AT = datetime.datetime(2024, 5, 6, 7, 8, 9)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_latest_file(spark, tmp_path):
    for name, age in (("t_1.csv", 30), ("t_2.csv", 10), ("sub/t_3.csv", 20)):
        put(tmp_path / name, "a\n1\n")
        os.utime(tmp_path / name, (1_700_000_000 - age,) * 2)
    files = list_files(spark, str(tmp_path))
    assert files.count() == 3
    newest = latest_file(files).collect()
    assert len(newest) == 1 and newest[0]["path"].endswith("/t_2.csv") and newest[0]["length"] == 4


def test_landing_keeps_paths_and_replaces_the_day(spark, tmp_path):
    put(tmp_path / "in/a/x.csv", "K\n1\n")
    put(tmp_path / "in/b/x.csv", "K\n 2 \n")
    put(tmp_path / "in/b/x.txt", "K\n9\n")
    for _ in range(2):
        landing = land_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-01")
    assert landing.files == 2
    out = landed(spark, str(tmp_path / "out"))
    assert rows(out.select("k", "source_name", "ds")) == [("1", "x.csv", "2024-01-01"), ("2", "x.csv", "2024-01-01")]
    assert len({r["source_path"] for r in out.collect()}) == 2
    land_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-02")
    assert out.count() == 2 and landed(spark, str(tmp_path / "out")).count() == 4


def test_landing_nothing_is_a_warning(spark, tmp_path, caplog):
    put(tmp_path / "in/x.txt", "K\n9\n")
    with caplog.at_level(logging.WARNING):
        assert land_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "d").files == 0
    assert "no files" in caplog.text and not os.path.exists(tmp_path / "out")


def test_streamed_landing_takes_each_file_once(spark, tmp_path):
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    put(tmp_path / "in/a.csv", 'K,V w\n1,"x\ny"\n')
    land_new_files(spark, *args, "2024-01-01", ["K", "V w"])
    put(tmp_path / "in/sub/b.csv", "K,V w\n2,\n")
    land_new_files(spark, *args, "2024-01-02", ["K", "V w"])
    land_new_files(spark, *args, "2024-01-03", ["K", "V w"])
    out = landed(spark, str(tmp_path / "out"))
    assert rows(out.selectExpr("k", "v_w", "source_name", "cast(ds as string)")) == [
        ("1", "x\ny", "a.csv", "2024-01-01"), ("2", None, "b.csv", "2024-01-02")]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    put(tmp_path / "in/a [1].csv", "K\n1\n2\n")
    files = [r["path"] for r in list_files(spark, str(tmp_path / "in")).collect()]
    for day in ("2024-01-01", "2024-01-01", "2024-01-02"):
        land_batch(spark, files, str(tmp_path / "out"), day, "stream", 0)
    assert rows(landed(spark, str(tmp_path / "out")).select("k", "ds")) == [("1", "2024-01-01"), ("2", "2024-01-01")]
    land_batch(spark, files, str(tmp_path / "out"), "2024-01-02", "stream", 1)
    assert landed(spark, str(tmp_path / "out")).count() == 4


def test_a_batch_that_fails_is_taken_by_the_next_call(spark, tmp_path):
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    put(tmp_path / "in/a.csv", "K\n1\n2,surplus\n")
    with pytest.raises(Exception, match="more cells than the header"):
        land_new_files(spark, *args, "d")
    put(tmp_path / "in/a.csv", "K\n1\n2\n")
    land_new_files(spark, *args, "d")
    assert rows(landed(spark, str(tmp_path / "out")).select("k")) == [("1",), ("2",)]


def test_a_large_new_file_is_read_in_many_tasks(spark, tmp_path):
    put(tmp_path / "in/a.csv", "K,T\n" + "".join(f'{i},"x\ny"\n' for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        land_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "d")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = landed(spark, str(tmp_path / "out"))
    assert out.count() == 20_000 and len(out.inputFiles()) > 5


def test_a_manifest_tells_what_has_changed(spark, tmp_path):
    manifest = FileManifest(spark, str(tmp_path / "kept"))
    for name in ("a.csv", "b/c.csv", "d.csv", "e.csv"):
        put(tmp_path / "in" / name, "x")
    assert {r["change"] for r in manifest.refresh(list_files(spark, str(tmp_path / "in"))).collect()} == {"new"}
    assert manifest.refresh(list_files(spark, str(tmp_path / "in"))).isEmpty()
    put(tmp_path / "in/a.csv", "longer")
    os.utime(tmp_path / "in/d.csv", (1_700_000_000,) * 2)
    os.remove(tmp_path / "in/b/c.csv")
    put(tmp_path / "in/new.csv", "y")
    changes = manifest.refresh(list_files(spark, str(tmp_path / "in")))
    put(tmp_path / "in/later.csv", "y")  # the answer stays
    assert sorted((r["path"].rsplit("/", 1)[1], r["change"], r["length"]) for r in changes.collect()) == [
        ("a.csv", "changed", 6), ("c.csv", "deleted", 1), ("d.csv", "changed", 1), ("new.csv", "new", 1)]
    assert manifest.listing().count() == 4


def test_replace_raw(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    replace_raw(normalize_cells(raw("a b", ("1", " "))), path, AT)
    stored = replace_raw(normalize_cells(raw("a", ("2"), ("3"))), path, AT)
    assert stored.dtypes == [("a", "string"), ("uploaded_at", "timestamp")]
    assert rows(stored.selectExpr("a", "cast(uploaded_at as string)")) == [
        ("2", "2024-05-06 07:08:09"), ("3", "2024-05-06 07:08:09")]
    assert replace_raw(raw("a", "1"), str(tmp_path / "u")).first()["uploaded_at"] is not None


@pytest.mark.parametrize("table", [None, "crashing"])
def test_a_job_that_dies_while_writing_leaves_the_old_rows(spark, raw, tmp_path, table):
    path = str(tmp_path / "t")
    old = replace_raw(raw("a", "1"), path, AT, table=table)
    broken = spark.range(1000, numPartitions=8).select(F.when(F.col("id") < 900, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("gone"))).alias("a"))
    with pytest.raises(Exception, match="gone"):
        replace_raw(broken, path, AT, table=table)
    assert rows(read_table(spark, path).select("a")) == rows(old.select("a")) == [("1",)]
    if table:
        assert rows(spark.sql(f"select a from raw.{table}")) == [("1",)]
        spark.sql(f"drop view raw.{table}")


def test_versions_are_cleaned_by_age(spark, raw, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    first = table.replace(raw("a", "1"))
    begun = table.read()
    second = table.replace(raw("a b", ("2", "x")))
    assert rows(begun) == [("1",)] and rows(table.read()) == [("2", "x")]  # a reader that began before still can
    os.utime(first.removeprefix("file:"), (time.time() - 90_000,) * 2)
    (tmp_path / "t/_data/version=writing/_temporary").mkdir(parents=True)
    os.utime(tmp_path / "t/_data/version=writing", (time.time() - 90_000,) * 2)
    table.replace(raw("a", "3"))
    left = sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/t/_data/version=*"))
    assert os.path.basename(first) not in left and os.path.basename(second) in left and "version=writing" in left
    for i in range(60):
        table.commits.force("", {**table.parts()[""], "n": i})
    table.commits.trim()
    assert rows(table.read()) == [("3",)] and len(os.listdir(tmp_path / "t/_commits")) < 110


def test_parts_are_replaced_one_by_one_also_with_other_columns(spark, raw, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    table.replace(raw("a", "1"), {"ds": "1", "source": "x"})
    table.replace(raw("a", "2"), {"ds": "2", "source": "x"})
    table.replace(raw("a", "3"), {"ds": "1", "source": "x"})
    assert rows(table.read()) == [("2", "2", "x"), ("3", "1", "x")]
    table.replace(raw("a b", ("4", "y")), {"ds": "3", "source": "x"})
    assert rows(table.read().select("a", "b")) == [("2", None), ("3", None), ("4", "y")]
    for wrong in ("", "a/b", "_x", ".."):
        with pytest.raises(ValueError):
            table.replace(raw("a", "1"), {"ds": wrong})
    with pytest.raises(FileNotFoundError):
        Versions(spark, str(tmp_path / "nothing")).read()


def test_one_of_many_commits_at_once_wins(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "c"), every=5)

    def add(i):
        tries = 0
        while True:
            state = log.state()
            tries += 1
            if log.commit(state, f"k{i}", {"on": state.number}):
                return tries

    with ThreadPoolExecutor(8) as pool:
        tries = list(pool.map(add, range(40)))
    state = log.state()
    assert state.number == 40 and sorted(e["on"] for e in state.entries.values()) == list(range(40)) and sum(tries) > 40
    log.trim()
    assert log.state() == state and not [n for n in os.listdir(tmp_path / "c") if n.startswith("_")]
    log.force("k3", None)
    assert "k3" not in log.state().entries and log.state().number == 41


def test_catalog_tables(spark, raw, tmp_path):
    replace_raw(raw("a", "1"), str(tmp_path / "r"), AT, table="loaded")
    assert spark.sql("select a from raw.loaded").first()["a"] == "1"
    replace_raw(raw("a", "2"), str(tmp_path / "r"), AT, table="loaded")
    assert rows(spark.sql("select a from raw.loaded")) == [("2",)]
    name = store_table(raw("a", "3"), "clean", "My Table", str(tmp_path / "c"))
    assert name == "clean.my_table" and rows(spark.table(name)) == [("3",)]
    for statement in ("drop view raw.loaded", "drop view clean.my_table"):
        spark.sql(statement)


def test_views_are_lazy_and_replaceable(spark, raw):
    create_view(raw("a", "1"), "clean", "T x")
    assert create_view(raw("a", "2"), "clean", "T x") == view_name("clean", "t_x") == "clean_t_x"
    assert rows(spark.table("clean_t_x")) == [("2",)]
    with pytest.raises(ValueError):
        view_name("bronze", "t")


def test_export_matches_a_csv_writer(spark, tmp_path):
    df = spark.sql(r"""
        select 1 n, ' a, "b"' || chr(10) || 'c ' t, cast(1.50 as decimal(38,2)) d, true b, date'2024-01-02' day,
               timestamp_ntz'2024-01-02 03:04:05.000006' ts
        union all select null, null, null, null, null, null
        union all select 2, '', cast(-2 as decimal(38,2)), false, date'2024-01-03', timestamp_ntz'2024-01-02 03:04:05'""")
    path = export_csv(df, str(tmp_path), "My Table", AT)
    assert path.endswith("/my_table/my_table_20240506070809")
    found = []
    for file in glob.glob(f"{path}/*.csv"):
        with open(file, newline="", encoding="utf-8") as handle:
            header, *lines = csv.reader(handle)
            assert header == ["n", "t", "d", "b", "day", "ts"]
            found += lines
    assert sorted(found) == sorted([
        ["1", ' a, "b"\nc ', "1.50", "True", "2024-01-02", "2024-01-02 03:04:05.000006"],
        ["", "", "", "", "", ""],
        ["2", "", "-2.00", "False", "2024-01-03", "2024-01-02 03:04:05"],
    ])
    back = read_raw(spark, path)
    assert rows(back.filter("n = 1").select("t", "ts")) == [('a, "b"\nc', "2024-01-02 03:04:05.000006")]


def test_publish_curated(spark, raw, tmp_path):
    raw("a", "1").write.parquet(str(tmp_path / "v"))
    for _ in range(2):
        out = publish_curated(spark, str(tmp_path / "v"), str(tmp_path / "c"))
    assert rows(out) == [("1",)]
    with pytest.raises(ValueError):
        publish_curated(spark, str(tmp_path / "v"), str(tmp_path / "v") + "/")


def test_payloads(spark, raw, tmp_path):
    put(tmp_path / "lines.json", '{"k": 1, "x": "a"}\n{"k": 2}\n')
    put(tmp_path / "doc/one.json", '[{"k": 3},\n {"k": 4}]')
    assert rows(read_payloads(spark, str(tmp_path / "lines.json"), "k INT, x STRING")) == [(1, "a"), (2, None)]
    assert rows(read_payloads(spark, str(tmp_path / "doc"), "k INT", whole_document=True)) == [(3,), (4,)]
    given = raw("id p", ("a", '{"k": 5, "z": 1}'), ("b", "not json"), ("c", None))
    df = expand_payload(given, "p", "k INT, m STRING", unreadable="text")
    assert df.columns == ["id", "k", "m", "text"] and rows(df) == [("a", 5, None, None), ("b", None, None, "not json"), ("c", None, None, None)]
    assert rows(expand_payload(given.filter("id <> 'b'"), "p", "k INT")) == [("a", 5), ("c", None)]
    put(tmp_path / "broken.json", '{"k": 1}\nnot json\n')
    for lost in (expand_payload(given, "p", "k INT, m STRING"), read_payloads(spark, str(tmp_path / "broken.json"), "k INT")):
        with pytest.raises(Exception, match="(?i)malformed"):
            lost.collect()
    assert rows(read_payloads(spark, str(tmp_path / "broken.json"), "k INT", unreadable="text")) == [(1, None), (None, "not json")]


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "public.t", partition_column="id", lower=0, upper=100, partitions=8, user="u")
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id" and options["user"] == "u"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "public.t")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "public.t", partition_column="id")


@pytest.mark.parametrize("scheme", ["file", "hdfs", "s3a"])
def test_a_file_is_created_once_in_each_way(spark, tmp_path, scheme):
    """The ways of other file systems, renames and conditional creates, on the local one."""
    class Named:
        def __init__(self, fs):
            self._fs = fs

        def getUri(self):
            return self

        def getScheme(self):
            return scheme

        def __getattr__(self, name):
            return getattr(self._fs, name)

    files = Files(spark, str(tmp_path / "c"))
    files._fs = Named(files._fs)
    assert files.create("a.json", b"first") and not files.create("a.json", b"second")
    assert files.read("a.json") == b"first" and list(files.names()) == ["a.json"]
    files.remove("a.json")
    assert files.create("a.json", b"third") and files.read("a.json") == b"third"
