import datetime
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from millrace.functions.times import time_literal
from millrace.plans.incremental import IncrementalExtract, current_watermarks
from millrace.reports.metadata import INGESTION_LOG, append_row, read_log
from millrace.sinks.commits import CommitLog

START = datetime.datetime(2024, 1, 1)


def source(spark, first, last):
    """One row a minute, from minute ``first`` to ``last`` inclusive."""
    return spark.range(first, last + 1).select(
        F.col("id"), F.timestamp_add("MINUTE", F.col("id").cast("int"), time_literal(START)).alias("updated_at"))


def minute(n):
    return START + datetime.timedelta(minutes=n)


@pytest.fixture
def job(tmp_path):
    return IncrementalExtract("p1", "public.t", f"{tmp_path}/data", f"{tmp_path}/log")


def ids(job, spark):
    return sorted(r["id"] for r in job.extracted(spark, source(spark, 0, 0).schema).collect())


def test_runs_take_what_is_new(spark, job):
    assert job.watermark(spark) == datetime.datetime(1970, 1, 1)
    first = job.run(source(spark, 1, 10), "2024-01-01", "a")
    assert (first.rows, first.watermark_from, first.watermark_to) == (10, datetime.datetime(1970, 1, 1), minute(10))
    second = job.run(source(spark, 1, 15), "2024-01-01", "b")
    assert (second.rows, second.watermark_from, second.watermark_to) == (5, minute(10), minute(15))
    third = job.run(source(spark, 1, 15), "2024-01-01", "c")
    assert (third.rows, third.watermark_to, third.path) == (0, None, None)
    # Two runs of one day keep both sets of rows.
    assert ids(job, spark) == list(range(1, 16))
    assert job.watermark(spark) == minute(15)
    log = {r["id"]: r for r in job.log(spark).collect()}
    assert [log[k]["rows_extracted"] for k in "abc"] == [10, 5, 0]
    assert {r["status"] for r in log.values()} == {"success"}
    assert "/ds=2024-01-01/run_id=b/attempt=" in log["b"]["path"]


def test_a_tie_on_the_mark_and_null_marks_are_not_extracted(spark, job):
    job.run(source(spark, 1, 5), "d", "a")
    late = source(spark, 5, 6).union(spark.sql("select 99L, cast(null as timestamp_ntz)"))
    assert job.run(late, "d", "b").rows == 1
    assert ids(job, spark) == [1, 2, 3, 4, 5, 6]


def test_a_failed_run_is_logged_and_changes_nothing(spark, job):
    job.run(source(spark, 1, 3), "d", "a")
    broken = source(spark, 1, 9).withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(
        F.raise_error(F.lit("source went away")).cast("bigint")))
    with pytest.raises(Exception, match="source went away"):
        job.run(broken, "d", "b")
    assert job.watermark(spark) == minute(3) and ids(job, spark) == [1, 2, 3]
    failed = job.log(spark).filter("status = 'failed'").first()
    assert "source went away" in failed["error_message"] and failed["watermark_from"] == minute(3)
    # The same run id again: the folder of the attempt that failed is not read.
    assert job.run(source(spark, 1, 9), "d", "b").rows == 6
    assert ids(job, spark) == list(range(1, 10))


def test_rows_of_a_run_that_died_before_its_log_entry_are_not_read(spark, job):
    job.run(source(spark, 1, 3), "d", "a")
    source(spark, 4, 6).write.parquet(f"{job.data_path}/ds=d/run_id=dead")
    assert ids(job, spark) == [1, 2, 3] and job.watermark(spark) == minute(3)
    assert job.run(source(spark, 1, 6), "d", "b").rows == 3
    assert ids(job, spark) == [1, 2, 3, 4, 5, 6]


class Cancelled(BaseException):
    """Like KeyboardInterrupt, no Exception."""


def slow_source(spark, first, last, action):
    """A source during whose extraction something else happens, once."""
    df, pending = source(spark, first, last), [action]

    class Slow:
        sparkSession, schema, columns = df.sparkSession, df.schema, df.columns

        def filter(self, condition):
            if pending:
                pending.pop()()
            return df.filter(condition)

    return Slow()


def test_a_cancelled_run_is_no_success(spark, job):
    def cancel():
        raise Cancelled("stop")

    with pytest.raises(Cancelled):
        job.run(slow_source(spark, 1, 5, cancel), "d", "a")
    assert [(r["status"], r["rows_extracted"]) for r in job.log(spark).collect()] == [("failed", 0)]
    assert job.committed(spark, "a") is None and ids(job, spark) == []
    assert job.run(source(spark, 1, 5), "d", "a").rows == 5 and ids(job, spark) == [1, 2, 3, 4, 5]


def test_a_run_that_overlaps_another_gives_each_row_once(spark, job):
    """The second run starts and ends while the first one writes; the first one then starts again from the newer mark."""
    late = job.run(slow_source(spark, 1, 12, lambda: job.run(source(spark, 1, 10), "d", "inner")), "d", "outer")
    assert (late.rows, late.watermark_from) == (2, minute(10)) and ids(job, spark) == list(range(1, 13))
    again = job.run(slow_source(spark, 1, 12, lambda: job.run(source(spark, 1, 13), "d", "third")), "d", "fourth")
    assert again.rows == 0 and ids(job, spark) == list(range(1, 14))
    assert {r["id"]: r["rows_extracted"] for r in job.log(spark).collect()} == {"inner": 10, "outer": 2, "third": 1, "fourth": 0}


def test_many_runs_at_once(spark, job):
    with ThreadPoolExecutor(5) as pool:
        found = list(pool.map(lambda i: job.run(source(spark, 1, 20 + i), "d", f"r{i}").rows, range(5)))
    newest = max(r["updated_at"] for r in job.extracted(spark, source(spark, 0, 0).schema).collect())
    assert sum(found) == len(ids(job, spark)) == len(set(ids(job, spark))) and newest >= minute(20)


def test_the_same_run_twice_at_once_is_one(spark, job):
    """A caller that gave a run up starts it again under its id, and both go on."""
    first = job.run(slow_source(spark, 1, 5, lambda: job.run(source(spark, 1, 5), "d", "a")), "d", "a")
    assert first.rows == 5 and ids(job, spark) == [1, 2, 3, 4, 5] and job.log(spark).count() == 1


@pytest.mark.parametrize("where", ["_write", "commit", "_append"])
def test_a_kill_at_any_point_is_safe(spark, job, monkeypatch, where):
    """Nothing runs after a kill, not even the code for errors."""
    job.run(source(spark, 1, 3), "d", "a")

    def dead(*args, **kwargs):
        raise Cancelled("killed")

    with monkeypatch.context() as patch:
        patch.setattr(IncrementalExtract, "_append", dead)
        if where == "_write":
            patch.setattr(IncrementalExtract, "_write", dead)
        elif where == "commit":
            patch.setattr(CommitLog, "commit", dead)
        with pytest.raises(Cancelled):
            job.run(source(spark, 1, 6), "d", "b")
    done = where == "_append"
    assert ids(job, spark) == list(range(1, 7 if done else 4))
    assert job.run(source(spark, 1, 6), "d", "b").rows == 3 and ids(job, spark) == list(range(1, 7))
    # The next run logs what a dead one has committed.
    assert sorted(r["id"] for r in job.log(spark).filter("status = 'success'").collect()) == ["a", "b"]


def test_rows_that_come_late_or_at_the_mark(spark, tmp_path):
    job = IncrementalExtract("p", "t", f"{tmp_path}/data", f"{tmp_path}/log", overlap=datetime.timedelta(minutes=30))
    job.run(source(spark, 1, 50).filter("id <> 40"), "d", "a")
    tie = source(spark, 50, 50).withColumn("id", F.lit(1000).cast("bigint"))
    assert job.run(source(spark, 1, 52).union(tie).union(tie), "d", "b").rows == 4  # 40, 51, 52 and one with the time of the mark
    assert ids(job, spark) == [*range(1, 53), 1000]
    assert job.run(source(spark, 1, 52).union(tie), "d", "c").rows == 0
    # What is older than the overlap is not looked at, neither in the source nor in what was extracted.
    old = source(spark, 5, 5).withColumn("id", F.lit(2000).cast("bigint"))
    assert job.run(source(spark, 1, 53).union(old), "d", "e").rows == 1
    read = job._extracted(spark, source(spark, 0, 0).schema, job.commits(spark).state()).filter(F.col("updated_at") > time_literal(minute(30)))
    assert "GreaterThan(updated_at" in plan_of(read)
    assert job.watermark(spark) == minute(53)


def test_a_log_from_before_commits_gives_the_mark(spark, job):
    append_row(spark, job.log_path, INGESTION_LOG, {"id": "old", "pipeline_id": "p1", "table_name": "public.t", "extracted_at": minute(0), "rows_extracted": 4,
                                                   "watermark_to": minute(4), "status": "success"})
    assert job.run(source(spark, 1, 6), "d", "b").rows == 2 and job.watermark(spark) == minute(6)
    assert job.run(source(spark, 1, 6), "d", "c").rows == 0


def test_pipelines_and_tables_have_marks_of_their_own(spark, tmp_path):
    jobs = [IncrementalExtract(p, t, f"{tmp_path}/{p}{t}", f"{tmp_path}/log") for p in ("p1", "p2") for t in ("x", "y")]
    for n, job in enumerate(jobs, 1):
        job.run(source(spark, 1, n), "d")
    log = read_log(spark, f"{tmp_path}/log", INGESTION_LOG)
    marks = {(r["pipeline_id"], r["table_name"]): r["last_watermark"] for r in current_watermarks(log).collect()}
    assert marks == {("p1", "x"): minute(1), ("p1", "y"): minute(2), ("p2", "x"): minute(3), ("p2", "y"): minute(4)}
    assert "pipeline_id" in plan_of(jobs[0].log(spark)).split("PartitionFilters:")[1].split("]")[0]


@pytest.mark.parametrize("kind", ["timestamp", "date"])
def test_other_mark_types(spark, tmp_path, kind):
    job = IncrementalExtract("p", "t", f"{tmp_path}/d", f"{tmp_path}/l", watermark_column="at")
    days = spark.range(1, 5).select("id", F.date_add(F.lit(START.date()), F.col("id").cast("int")).cast(kind).alias("at"))
    assert job.run(days.filter("id < 4"), "d").rows == 3
    assert job.run(days, "d").rows == 1


def test_first_mark_and_folder_names(spark, tmp_path):
    job = IncrementalExtract("p", "t", f"{tmp_path}/d", f"{tmp_path}/l", watermark_init="2024-01-01 00:03:00")
    assert job.run(source(spark, 1, 5), "d").rows == 2
    with pytest.raises(ValueError):
        job.run(source(spark, 1, 5), "../x")
    assert ids(job, spark) == [4, 5]


def test_the_mark_filter_reaches_the_scan(spark, job, tmp_path):
    source(spark, 1, 5).write.parquet(f"{tmp_path}/src")
    df = spark.read.parquet(f"{tmp_path}/src")
    plan = plan_of(df.filter(F.col("updated_at") > time_literal(minute(2)).cast(df.schema["updated_at"].dataType)))
    assert "GreaterThan(updated_at" in plan


def test_the_mark_does_not_depend_on_the_zone_of_the_machine(spark, job):
    import time

    old = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        job.run(source(spark, 1, 5), "d", "a")
        assert job.watermark(spark) == minute(5)
        assert job.run(source(spark, 1, 6), "d", "b").rows == 1
    finally:
        os.environ.pop("TZ") if old is None else os.environ.update(TZ=old)
        time.tzset()


def test_a_repeated_committed_run_answers_without_writing(spark, job):
    first = job.run(source(spark, 1, 10), "2024-01-01", "r1")
    assert job.run(source(spark, 1, 12), "2024-01-01", "r1") == first
    assert job.run(source(spark, 1, 12), "2024-01-02", "r1") == first
    assert ids(job, spark) == list(range(1, 11))


def test_one_id_under_two_days_is_read_once(spark, job):
    # The first attempt dies between its rows and the log; the next one runs on another day.
    source(spark, 1, 10).write.parquet(f"{job.data_path}/ds=2024-01-01/run_id=r1")
    assert job.run(source(spark, 1, 10), "2024-01-02", "r1").rows == 10
    assert ids(job, spark) == list(range(1, 11))
