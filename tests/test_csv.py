import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.upload import load_csv
from millrace.sources import records
from millrace.sources.csv import has_split_records, read_raw, scan_csv, store_csv
from millrace.sources.files import land_files
from millrace.streaming.landing import land_new_files


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        b'\xef\xbb\xbfOrder ID,Unit Price ($),, (x) \r\n'
        b'1,"two\nlines"," ""quoted"", comma ",4\r\n'
        b'2,  padded  ,\r\n'
        b'3,a,b,c,extra\r\n'
        b'4,"",\xc3\xa9,   \r\n')
    raw = scan_csv(spark, str(tmp_path / "a.csv"))
    assert raw.columns == ["order_id", "unit_price", "col", "x"]
    assert {t for _, t in raw.dtypes} == {"string"}
    with pytest.raises(Exception, match="more cells than the header in .*a.csv"):
        raw.collect()
    cells = [("1", "two\nlines", '"quoted", comma', "4"), ("2", "padded", None, None), ("3", "a", "b", "c"), ("4", None, "é", None)]
    assert rows(read_raw(spark, str(tmp_path), surplus="drop")) == cells
    assert rows(read_raw(spark, str(tmp_path), surplus="keep")) == [(*c, "extra" if c[0] == "3" else None) for c in cells]


def test_colliding_header_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A b,a-B\n1,2\n")
    with pytest.raises(ValueError, match="a_b"):
        scan_csv(spark, str(tmp_path))


def test_other_header_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="header"):
        scan_csv(spark, str(tmp_path)).collect()


def test_no_files_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    with pytest.raises(FileNotFoundError):
        scan_csv(spark, str(tmp_path), glob="*.csv")


def test_glob_recursion_and_provenance(spark, tmp_path):
    for name in ("a/x y+z%.csv", "b/x y+z%.csv", "b/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"v\n{name[0]}\n")
    df = scan_csv(spark, str(tmp_path), glob="*.csv", recursive=True, provenance=True)
    got = sorted((r["v"], r["source_path"].split("/", 1)[1].removeprefix("/").removeprefix("/"), r["source_name"])
                 for r in df.collect())
    assert [(v, name) for v, _, name in got] == [("a", "x y+z%.csv"), ("b", "x y+z%.csv")]
    assert all(path.endswith(f"{v}/x y+z%.csv") for v, path, _ in got)


def written(seed, records, newline):
    """A CSV file as text and its data rows, with line breaks, quotes and long cells."""
    rng = random.Random(seed)
    pieces = ["a", "b c", ",", '"', "\n", "\r\n", "é", "\\", "", "x" * 50, '""', "\n\n"]
    data = []
    for i in range(records):
        cell = "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        data.append([str(i), cell, "z" * 5000 + "\n" + "y" * 3000 if i % 97 == 5 else "t"])
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=newline)
    writer.writerows([["n", "cell", "last"], *data])
    return out.getvalue(), data


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_large_files_with_line_breaks_are_read_in_splits(spark, tmp_path, small_splits, newline):
    expected = []
    for seed in (1, 2):
        text, data = written(seed, 300, newline)
        (tmp_path / f"f {seed}.csv").write_text(text, newline="", encoding="utf-8")
        cells = [[c.replace("\r\n", "\n") if newline == "\r\n" else c for c in r] for r in data]
        expected += [[seed, *r] for r in cells]
    assert has_split_records(spark, str(tmp_path))
    df = scan_csv(spark, str(tmp_path), provenance=True)
    assert "from_csv" in df._jdf.queryExecution().toString()
    got = sorted([int(r["source_name"][2]), r["n"], r["cell"] or "", r["last"]] for r in df.collect())
    assert got == sorted(expected)
    one_task = scan_csv(spark, str(tmp_path), multi_line=True)
    assert sorted(map(str, rows(one_task))) == sorted(map(str, rows(df.select("n", "cell", "last"))))


def test_large_files_of_whole_lines_are_read_in_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("n,t\n" + "".join(f'{i},"a, ""b"" {i}"\n' for i in range(2000)))
    df = scan_csv(spark, str(tmp_path))
    assert df.select(F.spark_partition_id()).distinct().count() > 4
    assert sorted(rows(df)) == sorted((str(i), f'a, "b" {i}') for i in range(2000))


@pytest.mark.parametrize("whole", [True, False])
def test_stray_quotes_are_text_and_keep_the_splits(spark, tmp_path, small_splits, whole):
    stray = ['{i},5" pipe,z', '{i}, "b",z', '{i},"a"b,z', '{i},a""b"c,"d"']
    stray += [] if whole else ['{i},5" pipe,"x\ny"', '{i}, "b","x\n"",\n""y"']
    cells = [('5" pipe', "z"), (' "b"', "z"), None, ('a""b"c', "d"), ('5" pipe', "x\ny"), (' "b"', 'x\n",\n"y')]
    lines = [stray[i // 7 % len(stray)].format(i=i) if i % 7 == 0 else f"{i},plain,z" for i in range(1500)]
    (tmp_path / "a.csv").write_text("n,t,file\n" + "\n".join(lines) + "\n")
    df = scan_csv(spark, str(tmp_path))
    assert df.columns == ["n", "t", "file"]
    got = {int(r["n"]): (r["t"], r["file"]) for r in df.collect()}
    assert len(got) == df.count() == 1500
    for i in range(1500):
        expected = cells[i // 7 % len(stray)] if i % 7 == 0 else ("plain", "z")
        assert expected is None or got[i] == expected
    one_task = scan_csv(spark, str(tmp_path), multi_line=True)
    assert one_task.exceptAll(df).isEmpty()
    if whole:
        assert df.select(F.spark_partition_id()).distinct().count() > 4


def test_the_plan_does_not_depend_on_the_size(spark, tmp_path):
    text, _ = written(4, 200, "\n")
    (tmp_path / "a.csv").write_text(text, newline="", encoding="utf-8")
    found = []
    for size in ("2000", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = scan_csv(spark, str(tmp_path))
        found.append((sorted(map(str, rows(df))), "from_csv" in df._jdf.queryExecution().toString()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and found[0][1]


def test_large_and_small_files_together(spark, tmp_path, small_splits):
    (tmp_path / "big.csv").write_text("n,t\n" + "".join(f"{i},b\n" for i in range(1000)))
    (tmp_path / "small.csv").write_text('n,t\n-1,"s\nt"\n')
    text, data = written(3, 200, "\n")
    got = sorted(int(r["n"]) for r in scan_csv(spark, str(tmp_path)).collect())
    assert got == list(range(-1, 1000))


def test_assembled_files_must_share_the_header(spark, tmp_path, small_splits):
    body = "".join(f'{i},"a\nb"\n' for i in range(500))
    (tmp_path / "a.csv").write_text("n,t\n" + body)
    (tmp_path / "b.csv").write_text("t,n\n" + body)
    with pytest.raises(Exception, match="header"):
        scan_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("last", ["a, b", "a,", '"q,q",x', '"t""\nu",x'])
@pytest.mark.parametrize("multi_line", [None, True])
def test_surplus_cells_raise_by_file_name(spark, tmp_path, last, multi_line):
    """Short rows and commas inside quotes are no surplus; a comma too many is, however the file is read and whatever is selected."""
    (tmp_path / "a.csv").write_text('n,t\n1\n2,"x, ""y"", z"\n')
    assert rows(scan_csv(spark, str(tmp_path), surplus="raise")) == [("1", None), ("2", 'x, "y", z')]
    (tmp_path / "odd one.csv").write_text(f"n,t\n3,c\n4,{last}\n")
    df = scan_csv(spark, str(tmp_path), surplus="raise", multi_line=multi_line)
    for broken in (df.collect, df.select("n").collect, df.count):
        with pytest.raises(Exception, match="more cells than the header in .*odd one.csv"):
            broken()


@pytest.mark.parametrize("multi_line", [None, True, False])
def test_surplus_cells_are_kept_as_written(spark, tmp_path, multi_line):
    broken = "x\ny" if multi_line is not False else "xy"
    (tmp_path / "a.csv").write_text(f'n,t\n1,b\n2,"{broken}",c, "d" ,"e,f"\n3\n4,"a,""b""",\n5,,,\n')
    found = scan_csv(spark, str(tmp_path), surplus="keep", provenance=True, multi_line=multi_line)
    assert found.columns[-1] == "surplus_cells"
    assert {r["n"]: (r["t"] or "", r["surplus_cells"]) for r in found.collect()} == {
        "1": ("b", None), "2": (broken, 'c, "d" ,"e,f"'), "3": ("", None), "4": ('a,"b"', ""), "5": ("", ",")}
    assert scan_csv(spark, str(tmp_path), surplus="drop", multi_line=multi_line).count() == 5
    assert found.filter("surplus_cells is not null").select("n").count() == 3


def test_rejects_go_to_a_side_table(spark, tmp_path, small_splits):
    expected = []
    for name in ("one", "two"):
        lines, at = ["n,t"], 2
        for i in range(700):
            odd = i % 61 == 7
            cell = '"a\nb ' + "z" * 400 + '"' if i % 5 == 0 else "plain"
            lines.append(f"{i},{cell}" + (',more,"x\ny"' if odd else ""))
            if odd:
                expected.append((name, at, str(i), 'more,"x\ny"'))
            at += 1 + lines[-1].count("\n")
        (tmp_path / f"in/{name} file.csv").parent.mkdir(exist_ok=True)
        (tmp_path / f"in/{name} file.csv").write_text("\n".join(lines) + "\n")
    stored = store_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (stored.rows, stored.rejected) == (1400 - len(expected), len(expected))
    assert stored.raw.count() == stored.rows and stored.raw.columns == ["n", "t"]
    found = [(r["source_path"].rsplit("/", 1)[1][:3], r["line"], r["n"], r["surplus_cells"]) for r in stored.rejects.collect()]
    assert sorted(found) == sorted(expected)
    (tmp_path / "good.csv").write_text("n,t\n1,2\n")
    good = store_csv(spark, str(tmp_path / "good.csv"), str(tmp_path / "out2"))
    assert (good.rows, good.rejected, good.rejects.count(), rows(good.raw)) == (1, 0, 0, [("1", "2")])


def test_an_open_quote_names_its_file(spark, tmp_path, monkeypatch):
    """Also in a file that is one split."""
    monkeypatch.setattr(records, "LONGEST_RECORD", 5000)
    with gzip.open(tmp_path / "odd.csv.gz", "wt") as file:
        file.write('n,t\n1,"ok\nok"\n2,"never closed\n' + "more text\n" * 5000)
    with pytest.raises(Exception, match="a quoted cell is not closed, or too long, in .*odd.csv.gz"):
        scan_csv(spark, str(tmp_path)).count()


def test_surplus_cells_fail_loads_and_landings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("n,t\n1,b\n2,b,c\n")
    at = [str(tmp_path / "in"), str(tmp_path / "out")]
    for load in (lambda: load_csv(spark, at[0], "t", at[1]), lambda: load_csv(spark, at[0], "t", at[1], first_rows=1), lambda: land_files(spark, *at, "d"),
                 lambda: land_new_files(spark, *at, str(tmp_path / "checkpoint"), "d", ["n", "t"])):
        with pytest.raises(Exception, match="more cells than the header in .*a.csv"):
            load()
